"""Context-mixing range coder of id blocks: predictions of whole blocks, then many blocks side by side in numpy.

Every block is coded and read independently.  Within it an id is known by its number among the block's distinct ids in ascending
order; these and how often each occurs are stored with it.  Before each id three predictions are mixed:

    order 2   the id last seen after the same two ids, surer if it had come again itself
    order 1   the id last seen after the same id, likewise
    order 0   how often each id occurs in the block

Their weights depend on how sure the first two are.  The encoder knows the whole block, so it finds the
predictions of all places by sorting them by what came before, and stores as weights how often each prediction came true in each
of these cases.  What is left in lockstep, one id of each block in a step, is the range coder, and in reading the look-up of the predictions.

The range coder has 64 bits, emits words of 32, and carries into those it has emitted.  In the range order 2 comes first, then
order 1, then the counts.  All arithmetic is exact in integers, so that any machine reads what another wrote.

A block's bytes: ``MAGIC``, bits of an id (1), version (1), number of ids (4), CRC-32 of the ids as 4-byte numbers (4), size of the
table (4), the table (packed: which cases occur, their weights, steps between distinct ids, counts), code.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd

MAGIC, VERSION, HEAD = b"TLCM", 3, "<4sBBIII"
#: Most ids of a block: contexts and numbers have 12 bits.
BLOCK = 4096
#: What the weights of a case add up to, and how many cases there are: (how sure order 2 is, how sure order 1 is), 0 to 2 of 4 each.
WHOLE, CASES = 256, 16
#: Bits of a slot of order 2, and how many blocks of one size are planned at once.
CONTEXT, GROUP = 12, 16
#: As arrays, which numpy takes faster than Python's numbers.
_NUMBER, _SIZE, _CASE_BITS, _CASE_HIGH, _BITS = (np.array(x, np.uint16) for x in (BLOCK - 1, BLOCK, 10, 12, 12))
_NONE, _HALF, _FACTOR, _SLOT, _COUNT = (np.array(x) for x in (0, 16, 1597, (1 << CONTEXT) - 1, 0xFFFF))
_BITS32, _NUMBER32 = np.uint32(12), np.uint32(BLOCK - 1)
_WORD, _LOW32, _FULL = np.uint64(32), np.uint64((1 << 32) - 1), np.uint64((1 << 64) - 1)
#: A smaller range gives a word away.
_TOP = np.uint64(1 << 32)
_DAMAGED = "a block's ids don't have its checksum"


def bits_of(vocabulary: int) -> int:
    """Bits that any id below ``vocabulary`` has."""
    return max(1, int(vocabulary - 1).bit_length())


def _context(last: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The slot of order 2 of the two numbers before."""
    return before * _FACTOR + last & _SLOT


def _followers(context: np.ndarray, number: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At each place of blocks (rows): how sure is what came last after the same context, and whether it comes again.

    Sure is 0 if nothing has come, 2 if what came last had come again itself, else 1.  A number that nothing points to yet counts as 0.
    ``lead`` is the index of each block's first place.
    """
    keys = context << _BITS32
    keys |= np.arange(keys.shape[1], dtype=np.uint32)
    keys.sort(axis=1)
    same = np.zeros(keys.shape, bool)
    np.less(keys[:, 1:] ^ keys[:, :-1], BLOCK, out=same[:, 1:])
    keys &= _NUMBER32
    at = keys + lead
    after = number.take(at)
    guess = np.zeros(keys.shape, np.uint32)
    np.multiply(after[:, :-1], same[:, 1:], out=guess[:, 1:])
    hit = after == guess
    found = same.view(np.uint8) << 1
    found[:, 1:] += (same[:, 1:] & hit[:, :-1]).view(np.uint8) << 1
    found |= (hit & same).view(np.uint8)
    out = np.empty(keys.size, np.uint8)
    out[at.ravel()] = found.ravel()
    return out >> 1, (out & 1).view(bool)


def _planned(blocks: np.ndarray, bits: int) -> tuple[list[bytes], np.ndarray]:
    """The tables of up to ``GROUP`` blocks of one size (rows), and for each id where the part of the range begins (the lower half) and its size.

    The range has ``WHOLE`` times as many parts as the block has ids.
    """
    n, size = blocks.shape
    block, lead = np.arange(n), np.arange(0, n * size, size)[:, None]
    # numbers: places sorted by id
    kind = np.uint32 if bits <= 20 else np.uint64
    keys = blocks.astype(kind) << kind(12)
    keys |= np.arange(size, dtype=kind)
    keys.sort(axis=1)
    place = (keys & kind(BLOCK - 1)).astype(np.int64)
    place += lead
    keys >>= kind(12)
    new = np.ones(keys.shape, bool)
    np.not_equal(keys[:, 1:], keys[:, :-1], out=new[:, 1:])
    begin = np.flatnonzero(new)
    own, distinct = begin // size, keys.ravel()[begin].astype(np.int64)
    count, start = np.diff(np.append(begin, n * size)), begin % size
    ends = np.searchsorted(own, np.arange(n + 1))
    number = np.empty(keys.shape, np.uint32)
    number.ravel()[place.ravel()] = (np.cumsum(new, axis=1, dtype=np.uint32) - np.uint32(1)).ravel()
    last, before = np.zeros(keys.shape, np.uint32), np.zeros(keys.shape, np.uint32)
    last[:, 1:], before[:, 2:] = number[:, :-1], number[:, :-2]
    sure2, hit2 = _followers(before * np.uint32(_FACTOR) + last & np.uint32(_SLOT), number, lead)
    sure1, hit1 = _followers(last, number, lead)
    of = (number + ends[:-1, None]).ravel()
    block = block.repeat(size)
    case = (sure2 << 4) + (sure1 << 2) + np.where(hit2, np.uint8(0), np.uint8(2) - hit1.view(np.uint8))
    row = block * (4 * CASES) + case
    tally = np.bincount(row, minlength=4 * CASES * n).reshape(-1, CASES, 4)[:, :, :3]
    whole = tally.sum(2)
    weight = np.zeros((n, CASES, 3), np.int64)
    # what has come true has a weight of 1 at least, and order 0 always has one
    weight[:, :, :2] = np.maximum((WHOLE - 3) * tally[:, :, :2] // np.maximum(whole, 1)[:, :, None], tally[:, :, :2] > 0)
    weight[:, :, 2] = WHOLE - weight[:, :, 0] - weight[:, :, 1]
    used, small = whole > 0, weight[:, :, :2].astype(np.uint8)
    steps = distinct.copy()
    steps[1:] -= distinct[:-1]
    steps[ends[:-1]] = distinct[ends[:-1]]
    planes = [x.astype(f"<u{size}").view(np.uint8).reshape(-1, size)[:, k].tobytes() for x, size in ((steps, 4), (count, 2)) for k in range(size)]
    at = ends.tolist()
    tables = [zlib.compress(b"".join((np.packbits(used[k]).tobytes(), small[k][used[k]].tobytes(), *(x[at[k] : at[k + 1]] for x in planes))), 1) for k in range(n)]
    # by case and kind: where the part begins and its size, and how often the id's own counts are added to both
    fixed, each = np.zeros((2, n, CASES, 4), np.int64)
    fixed[:, :, 1], fixed[:, :, 2] = weight[:, :, 0] * size, (weight[:, :, 0] + weight[:, :, 1]) * size
    fixed[:, :, :2] += weight[:, :, :2] * size << 32
    each[:, :, 2] = weight[:, :, 2]
    parts = (count << 32 | start).take(of)
    parts *= each.take(row)
    parts += fixed.take(row)
    return tables, parts.view(np.uint64).reshape(n, size)


def _table(packed: bytes, n: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of all cases, distinct ids and counts of a block."""
    try:
        raw = np.frombuffer(zlib.decompress(packed), np.uint8)
        used = np.unpackbits(raw[: CASES // 8]).view(bool)
        at = CASES // 8 + 2 * int(used.sum())
        weight = np.zeros((CASES, 3), np.int64)
        weight[used, :2] = raw[CASES // 8 : at].reshape(-1, 2)
        to = at + (len(raw) - at) // 6 * 4
        steps, count = np.ascontiguousarray(raw[at:to].reshape(4, -1).T).view("<u4")[:, 0], np.ascontiguousarray(raw[to:].reshape(2, -1).T).view("<u2")[:, 0]
    except (zlib.error, ValueError, IndexError) as e:
        raise ValueError(_DAMAGED) from e
    weight[:, 2] = WHOLE - weight[:, 0] - weight[:, 1]
    distinct = np.cumsum(steps, dtype=np.int64)
    if int(count.sum(dtype=np.int64)) != n or (weight[:, 2] < 1).any() or int(distinct[-1]) >> bits:
        raise ValueError(_DAMAGED)
    return weight, distinct, count


def _spans(sizes: np.ndarray):
    """(first step, last step, lanes at work) of blocks in order of falling size."""
    at = 0
    for end in np.unique(sizes).tolist():
        if end > at:
            yield at, end, int(np.searchsorted(-sizes, -at, "left"))
            at = end


def _parts(sizes: np.ndarray):
    """How many parts the range has in each lane: one number if all have as many, which numpy divides by much faster."""
    all_ = (sizes * WHOLE).astype(np.uint64)
    return all_[0] if (all_ == all_[0]).all() else all_


def encode_blocks(blocks: list[np.ndarray], bits: int) -> list[bytes]:
    """Each block's bytes; a block has at most ``BLOCK`` ids of ``bits`` bits."""
    if not blocks:
        return []
    sizes = np.array([len(b) for b in blocks])
    order = np.argsort(-sizes, kind="stable")
    falling = sizes[order]
    n, most = len(blocks), int(falling[0])
    if most > BLOCK:
        raise ValueError("a block has too many ids")
    falling_blocks = [np.asarray(blocks[b]) for b in order.tolist()]
    spans = np.zeros((most, n), np.uint64)
    tables = [b""] * n
    base, busy = 0, int((falling > 0).sum())
    while base < busy:
        size = int(falling[base])
        to = min(base + GROUP, int(np.searchsorted(-falling, -size, "right")))
        some = np.stack(falling_blocks[base:to])
        if some.min() < 0 or int(some.max()) >> bits:
            raise ValueError("an id is outside the vocabulary")
        tables[base:to], parts = _planned(some, bits)
        spans[:size, base:to] = parts.T
        base = to
    out = np.zeros((most + 2, n), np.uint32)
    # places in ``out``
    flat, used = out.ravel(), np.arange(n)
    low_all, range_all = np.zeros(n, np.uint64), np.full(n, _FULL)
    for first, last, lanes in _spans(falling):
        low, width, place, parts = low_all[:lanes], range_all[:lanes], used[:lanes], _parts(falling[:lanes])
        for t in range(first, last):
            part, span = width // parts, spans[t, :lanes]
            np.multiply(part, span >> _WORD, out=width)
            part *= span & _LOW32
            low += part
            carry = np.flatnonzero(low < part)
            if len(carry):
                to = place[carry]
                while len(to):
                    to = to - n
                    flat[to] += np.uint32(1)
                    to = to[flat[to] == 0]
            go = np.flatnonzero(width < _TOP)
            moved, to = low.take(go), place.take(go)
            flat[to] = moved >> _WORD
            low[go] = moved << _WORD
            width[go] = width.take(go) << _WORD
            place[go] = to + n
    used //= n
    lane = np.arange(n)
    flat[used * n + lane] = low_all >> _WORD
    flat[(used + 1) * n + lane] = low_all & _LOW32
    results: list[bytes] = [b""] * n
    code = np.ascontiguousarray(out.T.astype("<u4"))
    for lane, b in enumerate(order.tolist()):
        head = struct.pack(HEAD, MAGIC, bits, VERSION, int(sizes[b]), zlib.crc32(np.asarray(blocks[b]).astype("<u4").tobytes()), len(tables[lane]))
        results[b] = head + tables[lane] + code[lane, : used[lane] + 2].tobytes()
    return results


class Reader:
    """The predictions of ``lanes`` blocks at the same place."""

    def __init__(self, tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]], sizes: np.ndarray):
        lanes = len(tables)
        # lanes don't lie at multiples of a power of two, which would share few places of the processor's caches
        each = np.array([len(count) for _, _, count in tables]) + 1
        self.numbers = np.cumsum(each) - each
        self.places, self.contexts = np.arange(lanes) * (BLOCK + 96), np.arange(lanes) * ((1 << CONTEXT) + 96)
        # by count: the id's number; by number: where its counts begin, and how many; by context: number + BLOCK * sure
        self.slots, self.slots2 = np.zeros(lanes * (BLOCK + 96), np.uint16), np.zeros(lanes * ((1 << CONTEXT) + 96), np.uint16)
        self.held, self.slots1 = np.zeros(each.sum(), np.uint32), np.zeros(each.sum(), np.uint16)
        weight = np.zeros((lanes, CASES, 3), np.int64)
        for lane, (own, _, count) in enumerate(tables):
            self.slots[self.places[lane] : self.places[lane] + sizes[lane]] = np.arange(len(count), dtype=np.uint16).repeat(count)
            self.held[self.numbers[lane] : self.numbers[lane] + len(count)] = np.cumsum(count) - count << 16 | count
            weight[lane] = own
        ends = np.cumsum(weight[:, :, :2], 2) * sizes[:, None, None]
        self.end2, self.end1, self.each = (np.ascontiguousarray(x).ravel() for x in (ends[:, :, 0], ends[:, :, 1], weight[:, :, 2]))
        self.cases = np.arange(lanes) * CASES
        self.last, self.before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)

    def narrow(self, lanes: int) -> None:
        """Go on with the first lanes only."""
        self.numbers, self.places, self.contexts, self.cases, self.last, self.before = (x[:lanes] for x in (self.numbers, self.places, self.contexts, self.cases, self.last, self.before))

    def find(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The number whose part of the range holds ``target``, where the part begins, and its size; then go on to the next place."""
        at2 = _context(self.last, self.before)
        at2 += self.contexts
        at1 = self.numbers + self.last
        s2, s1 = self.slots2.take(at2), self.slots1.take(at1)
        case = s2 >> _CASE_BITS
        case &= _CASE_HIGH
        case |= s1 >> _BITS
        row = self.cases + case
        s2 &= _NUMBER
        s1 &= _NUMBER
        end2, end1, each = self.end2.take(row), self.end1.take(row), self.each.take(row)
        in2, in1 = target < end2, target < end1
        # beside the counts the quotient means nothing; it is at most the number of ids less one
        rest = target - end1
        rest //= each
        np.maximum(rest, _NONE, out=rest)
        rest += self.places
        number = self.slots.take(rest)
        held = self.held.take(self.numbers + number).astype(np.int64)
        size = held & _COUNT
        size *= each
        held >>= _HALF
        held *= each
        held += end1
        # order 2 lies in what order 1 ends
        number = np.where(in2, s2, np.where(in1, s1, number))
        begin = np.where(in1, end2, held)
        begin *= ~in2
        size = np.where(in2, end2, np.where(in1, end1 - end2, size))
        own = number + _SIZE
        again = own + _SIZE
        self.slots2[at2] = np.where(number == s2, again, own)
        self.slots1[at1] = np.where(number == s1, again, own)
        self.before, self.last = self.last, number.astype(np.int64)
        return number, begin, size


def decode_blocks(coded: list[bytes]) -> list[np.ndarray]:
    """The ids of each block, as 4-byte numbers; a block that isn't whole raises an error."""
    if not coded:
        return []
    skip = struct.calcsize(HEAD)
    heads = [struct.unpack(HEAD, c[:skip]) if len(c) >= skip else (b"",) * 6 for c in coded]
    if any(h[0] != MAGIC or h[2] != VERSION or h[1] != heads[0][1] or h[3] > BLOCK for h in heads):
        raise ValueError("not blocks of ids of this version")
    sizes = np.array([h[3] for h in heads])
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    results: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(coded)
    if len(order):
        falling = sizes[order]
        n, most = len(order), int(falling[0])
        tables = [_table(coded[b][skip : skip + heads[b][5]], int(sizes[b]), heads[b][1]) for b in order.tolist()]
        words = np.zeros((n, max(len(c) for c in coded) // 4 + 3), np.uint32)
        for lane, b in enumerate(order.tolist()):
            from_ = skip + heads[b][5]
            held = np.frombuffer(coded[b], "<u4", (len(coded[b]) - from_) // 4, from_)
            words[lane, : len(held)] = held
        words = np.ascontiguousarray(words.T)
        flat, last_word = words.ravel(), words.size - 1
        reader, numbers = Reader(tables, falling), np.zeros((most, n), np.uint16)
        range_all = np.full(n, _FULL)
        code_all = words[0].astype(np.uint64) << _WORD | words[1]
        # places in ``words``
        used = np.arange(2 * n, 3 * n)
        for first, last, lanes in _spans(falling):
            reader.narrow(lanes)
            width, place, code, parts = range_all[:lanes], used[:lanes], code_all[:lanes], _parts(falling[:lanes])
            most_ = parts - np.uint64(1)
            for t in range(first, last):
                part = width // parts
                target = np.minimum(code // part, most_).view(np.int64)
                numbers[t, :lanes], begin, size = reader.find(target)
                np.multiply(part, size.view(np.uint64), out=width)
                part *= begin.view(np.uint64)
                code -= part
                go = np.flatnonzero(width < _TOP)
                to = place.take(go)
                code[go] = code.take(go) << _WORD | flat.take(np.minimum(to, last_word))
                width[go] = width.take(go) << _WORD
                place[go] = to + n
        numbers = np.ascontiguousarray(numbers.T)
        for lane, b in enumerate(order.tolist()):
            results[b] = tables[lane][1][numbers[lane, : sizes[b]]].astype(np.uint32)
    for ids, head in zip(results, heads, strict=True):
        if zlib.crc32(ids.astype("<u4").tobytes()) != head[4]:
            raise ValueError(_DAMAGED)
    return results
