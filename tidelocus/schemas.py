"""Fixed schemas.  Coordinates are 1-based and closed; nothing is inferred from data."""

ALIGNMENTS = (
    "qname string, flag int, chrom_id int, chrom string, pos bigint, end_pos bigint, mapq int, cigar array<struct<op:string,len:int>>, "
    "mate_chrom_id int, mate_chrom string, mate_pos bigint, tlen int, seq string, qual string"
)
CHROMOSOMES = "chrom_id int, chrom string, length bigint"
REGIONS = "chrom string, first bigint, last bigint"
CLIPS = "chrom string, pos bigint, left_count bigint, right_count bigint, mate_in_rep bigint"
PEAKS = "chrom string, pos bigint, max_both bigint, left_sd double, right_sd double, both_sd double"
DISCORDANT = "locus string, mate_chrom string, mate_pos bigint, left_count bigint, right_count bigint, mate_in_rep bigint"
INFO = "bam string, cov double, read_length bigint, insert_size_mean double, insert_size_sd double"
REPEATS = "row_no bigint, chrom string, begin bigint, end bigint, strand string, label string, class string"
SEQUENCES = "name string, seq string"
READS = "id string, seq string, qual string"
