"""Byte-level BPE: texts to the ids of a rank file, and ids back to bytes.

Texts are split into pre-tokens with numpy, many texts at a time. A minimal perfect hash
resolves at once all pre-tokens that are a whole entry of the vocabulary. What it misses is
merged pair by pair, with a heap over linked bytes, once per distinct pre-token.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Sequence
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

from .arrow import map_texts
from .words import mix

SLICE_BYTES = 1 << 20
MEMO_PIECES = 400_000
KEY_BYTES = 16

OTHER, LETTER, NUMBER, SPACE, BREAK = range(5)
_BREAK_CODE = sys.maxunicode + 1

# The white space of Unicode, and the endings split off after an apostrophe.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B)] + [
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)


def code_classes() -> np.ndarray:
    """The class of each code point: letter, number, white space or other."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.array(
        [kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(_BREAK_CODE)] + [BREAK],
        dtype=np.uint8,
    )
    table[WHITE_SPACE] = SPACE
    return table


def token_starts(codes: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin, for code points of texts that are set apart by BREAK.

    A run of letters, of numbers or of other characters is one, together with one space
    (U+0020) before it. A run of white space before something else leaves its last character
    to that, or to itself where it is not a space. An apostrophe at the beginning of a
    pre-token takes one of ENDINGS with it.
    """
    before = np.concatenate([[np.uint8(BREAK)], kind[:-1]])
    after = np.concatenate([kind[1:], [np.uint8(BREAK)]])
    last = np.concatenate([[np.uint32(_BREAK_CODE)], codes[:-1]])
    space_before = last == 0x20
    run = kind != before
    starts = run & ~(space_before & (kind != SPACE) & (kind != BREAK))
    starts |= (kind == SPACE) & (after != SPACE) & (after != BREAK)
    for place in np.flatnonzero(run & (codes == 0x27) & ~space_before).tolist():
        if place + 1 >= len(codes) or kind[place + 1] != LETTER:
            continue
        following = "".join(map(chr, codes[place + 1 : place + 3] % _BREAK_CODE))
        for ending in ENDINGS:
            if following.startswith(ending):
                starts[place + 1] = False
                stop = place + 1 + len(ending)
                if len(ending) == 2:
                    starts[place + 2] = False
                if stop < len(codes) and kind[stop] == LETTER:
                    starts[stop] = True
                break
    return starts


def _keys(buffer: np.ndarray, begin: np.ndarray, size: np.ndarray):
    """The first 16 bytes of each piece as two numbers; with the size they are the piece."""
    words = np.ndarray((len(buffer) - 7,), dtype="<u8", buffer=buffer.data, strides=(1,))
    low = words[begin] & _MASKS[np.minimum(size, 8)]
    high = words[np.minimum(begin + 8, len(words) - 1)] & _MASKS[np.clip(size - 8, 0, 8)]
    return low, high


def _hash(low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
    return mix(mix(low + _GOLDEN) ^ (high * _GOLDEN + size.astype(np.uint64)))


class PerfectHash:
    """A minimal perfect hash of the vocabulary entries of up to 16 bytes.

    Hash and displace: entries fall into buckets; large buckets first, each looks for a
    displacement that sends its entries to free slots; a bucket of one entry names its slot.
    There are as many slots as entries. A slot holds its entry, so that other pieces are told
    from it.
    """

    def __init__(self, entries: list[tuple[bytes, int]]):
        n = self.n = len(entries)
        joined = b"".join(piece for piece, _ in entries) + bytes(KEY_BYTES + 8)
        size = np.array([len(piece) for piece, _ in entries], dtype=np.int64)
        begin = np.cumsum(size) - size
        low, high = _keys(np.frombuffer(joined, dtype=np.uint8), begin, size)
        hashes = _hash(low, high, size)
        self.buckets = max(1, n // 4)
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        counts = np.bincount(bucket, minlength=self.buckets)
        ends = np.cumsum(counts)
        self.shift = np.zeros(self.buckets, dtype=np.int64)
        taken, place = np.zeros(n, dtype=bool), np.zeros(n, dtype=np.int64)
        tries = np.arange(1, 65, dtype=np.uint64)
        singles = []
        for b in np.argsort(-counts, kind="stable").tolist():
            members = order[ends[b] - counts[b] : ends[b]]
            if len(members) < 2:
                singles += [(b, m) for m in members.tolist()]
                continue
            offset = np.uint64(0)
            while True:
                slots = self._slots(hashes[members][:, None], tries[None, :] + offset)
                ordered = np.sort(slots, axis=0)
                fits = ~taken[slots].any(axis=0) & (ordered[1:] != ordered[:-1]).all(axis=0)
                if fits.any():
                    at = int(np.argmax(fits))
                    self.shift[b] = int(tries[at] + offset)
                    taken[slots[:, at]] = True
                    place[members] = slots[:, at]
                    break
                offset += np.uint64(64)
        for (b, m), slot in zip(singles, np.flatnonzero(~taken).tolist(), strict=True):
            self.shift[b], place[m] = -slot - 1, slot
        self.low, self.high = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        self.size, self.rank = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        self.low[place], self.high[place], self.size[place] = low, high, size
        self.rank[place] = [rank for _, rank in entries]

    def _slots(self, hashes: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (mix(hashes + shift * _GOLDEN) % np.uint64(self.n)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray, size: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The rank of each piece, -1 where it is not an entry."""
        shift = self.shift[(hashes % np.uint64(self.buckets)).astype(np.int64)]
        slot = np.where(shift < 0, -shift - 1, self._slots(hashes, shift.astype(np.uint64)))
        same = (self.low[slot] == low) & (self.high[slot] == high) & (self.size[slot] == size)
        return np.where(same, self.rank[slot], -1)


def merge_table(ranks: dict[bytes, int]) -> dict[int, int]:
    """For two neighbouring ids, as ``left << 32 | right``, the id of what they make."""
    found = {}
    for entry, rank in ranks.items():
        for cut in range(1, len(entry)):
            left, right = ranks.get(entry[:cut]), ranks.get(entry[cut:])
            if left is not None and right is not None:
                found[left << 32 | right] = rank
    return found


def merge(piece: bytes, single: list[int], pairs: dict[int, int]) -> list[int]:
    """The ids of one pre-token: the pair that makes the lowest rank is joined first, the
    leftmost of equal ones, until no neighbours make an entry.

    The bytes are a linked list. A heap item is ``rank << 32 | position``; one that is no
    longer what ``waiting`` says about its position is stale.
    """
    n, get = len(piece), pairs.get
    ids = [single[byte] for byte in piece]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    waiting = [-1] * n
    heap = []
    for i in range(n - 1):
        rank = get(ids[i] << 32 | ids[i + 1])
        if rank is not None:
            waiting[i] = item = rank << 32 | i
            heap.append(item)
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        item = pop(heap)
        left = item & 0xFFFFFFFF
        if waiting[left] != item:
            continue
        right = after[left]
        ids[left], waiting[right] = item >> 32, -2
        after[left] = right = after[right]
        waiting[left] = -1
        if right < n:
            before[right] = left
            rank = get(ids[left] << 32 | ids[right])
            if rank is not None:
                waiting[left] = item = rank << 32 | left
                push(heap, item)
        one = before[left]
        if one >= 0:
            rank = get(ids[one] << 32 | ids[left])
            if rank is None:
                waiting[one] = -1
            else:
                waiting[one] = item = rank << 32 | one
                push(heap, item)
    found, left = [], 0
    while left < n:
        found.append(ids[left])
        left = after[left]
    return found


class Vocabulary:
    """Entries of a rank file; ids are ranks and need not be dense."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(entry): int(rank) for entry, rank in pairs}
        self.short = PerfectHash([(e, r) for e, r in self.ranks.items() if len(e) <= KEY_BYTES])
        self.long = {e: r for e, r in self.ranks.items() if len(e) > KEY_BYTES}
        self.single = [self.ranks[bytes([byte])] for byte in range(256)]
        self.pairs = merge_table(self.ranks)
        self.classes = code_classes()
        top = max(self.ranks.values()) + 1
        entries: list[bytes] = [b""] * top
        for entry, rank in self.ranks.items():
            entries[rank] = entry
        self.entry_sizes = np.array([len(e) for e in entries], dtype=np.int64)
        self.entry_begins = np.cumsum(self.entry_sizes) - self.entry_sizes
        self.entry_bytes = np.frombuffer(b"".join(entries), dtype=np.uint8)

    def encode(self, texts: Sequence[bytes], memo: dict[bytes, list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has. ``memo`` holds what was merged."""
        data = b"".join(texts)
        if not data:
            return np.empty(0, np.int64), np.zeros(len(texts), np.int64)
        codes = np.frombuffer(data.decode().encode("utf-32-le"), dtype=np.uint32)
        widths = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
        # Where texts end, in code points; a break goes there.
        text_bytes = np.cumsum([len(text) for text in texts])
        cuts = np.searchsorted(np.cumsum(widths), text_bytes, side="left") + 1
        cuts[text_bytes == 0] = 0
        codes = np.insert(codes, cuts, _BREAK_CODE)
        widths = np.insert(widths, cuts, 0)
        kind = self.classes[codes]
        starts = np.flatnonzero(token_starts(codes, kind))
        offset = np.cumsum(widths) - widths
        begin = offset[starts]
        size = np.append(begin[1:], len(data)) - begin
        real = size > 0
        begin, size = begin[real], size[real]

        buffer = np.frombuffer(data + bytes(KEY_BYTES + 8), dtype=np.uint8)
        low, high = _keys(buffer, begin, size)
        hashes = _hash(low, high, size)
        ids = self.short.find(low, high, size, hashes)
        ids[size > KEY_BYTES] = -1
        counts = np.ones(len(ids), dtype=np.int64)

        missed = np.flatnonzero(ids < 0)
        pieces: list[list[int]] = []
        owner = np.empty(0, np.int64)
        if len(missed):
            long = size[missed] > KEY_BYTES
            short, far = missed[~long], missed[long]
            _, first, same = np.unique(hashes[short], return_index=True, return_inverse=True)
            chosen = short[first]
            if not ((low[chosen][same] == low[short]) & (high[chosen][same] == high[short])).all():
                chosen, same = short, np.arange(len(short))
            owner = np.empty(len(missed), np.int64)
            owner[~long] = same
            owner[long] = len(chosen) + np.arange(len(far))
            for at, length in zip(
                np.concatenate([begin[chosen], begin[far]]).tolist(),
                np.concatenate([size[chosen], size[far]]).tolist(),
                strict=True,
            ):
                piece = data[at : at + length]
                made = memo.get(piece)
                if made is None:
                    whole = self.long.get(piece)
                    made = merge(piece, self.single, self.pairs) if whole is None else [whole]
                    if length <= 4 * KEY_BYTES:
                        if len(memo) >= MEMO_PIECES:
                            memo.clear()
                        memo[piece] = made
                pieces.append(made)
            lengths = np.array([len(p) for p in pieces], dtype=np.int64)
            counts[missed] = lengths[owner]
        total = int(counts.sum())
        places = np.cumsum(counts) - counts
        out = np.empty(total, dtype=np.int64)
        hit = ids >= 0
        out[places[hit]] = ids[hit]
        if len(missed):
            flat = np.fromiter(chain.from_iterable(pieces), dtype=np.int64)
            from_begin = (np.cumsum(lengths) - lengths)[owner]
            n = lengths[owner]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(places[missed], n) + step] = flat[np.repeat(from_begin, n) + step]
        # Ids of a text: those of the pre-tokens that begin in it.
        text_of = np.searchsorted(text_bytes, begin, side="right")
        return out, np.bincount(text_of, counts, len(texts)).astype(np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        sizes = self.entry_sizes[ids]
        step = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return self.entry_bytes[np.repeat(self.entry_begins[ids], sizes) + step].tobytes()


def _slices(texts: list[bytes]):
    part, held = [], 0
    for text in texts:
        part.append(text)
        held += len(text)
        if held >= SLICE_BYTES:
            yield part
            part, held = [], 0
    if part:
        yield part


def encode_documents(
    docs: DataFrame, path: str, text: str = "text", keep=("doc_id",), with_ids: bool = True
) -> DataFrame:
    """``keep`` columns, ``ids`` (array of bigint; left out unless ``with_ids``), ``n_tokens``,
    ``ids_sha256`` (of the ids as little-endian unsigned 32-bit numbers) and
    ``decoded_sha256`` (of the bytes that the ids decode to), for whole texts.

    A null or empty text has no ids and the digests of no bytes. ``path`` is a rank file that
    the driver can read; executors get its tables with the task. Memory goes with the longest
    single text.
    """
    vocabulary = Vocabulary(path)
    tables = docs.sparkSession.sparkContext.broadcast(vars(vocabulary) | {"short": vars(vocabulary.short)})
    made: dict[str, Vocabulary] = {}
    memo: dict[bytes, list[int]] = {}

    def compute(texts: list[bytes]):
        if not made:
            made["v"] = own = Vocabulary.__new__(Vocabulary)
            vars(own).update(tables.value)
            own.short = PerfectHash.__new__(PerfectHash)
            vars(own.short).update(tables.value["short"])
        words = made["v"]
        all_ids, n_tokens, digests, decoded = [], [], [], []
        for part in _slices(texts):
            ids, counts = words.encode(part, memo)
            ends = np.cumsum(counts)
            raw = ids.astype("<u4").tobytes()
            back = words.decode(ids)
            byte_ends = np.cumsum(np.bincount(np.repeat(np.arange(len(part)), counts), words.entry_sizes[ids], len(part)))
            at = byte_at = 0
            for end, byte_end in zip(ends.tolist(), byte_ends.astype(np.int64).tolist(), strict=True):
                digests.append(hashlib.sha256(raw[4 * at : 4 * end]).hexdigest())
                decoded.append(hashlib.sha256(back[byte_at:byte_end]).hexdigest())
                if with_ids:
                    all_ids.append(ids[at:end])
                at, byte_at = end, byte_end
            n_tokens += counts.tolist()
        return [*([all_ids] if with_ids else []), n_tokens, digests, decoded]

    fields = [("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    return map_texts(docs, text, [*([("ids", "array<bigint>")] if with_ids else []), *fields], compute, keep)
