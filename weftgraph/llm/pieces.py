"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding.

Agenda processing merges, of all candidate pairs of neighbouring symbols, the pair whose piece has
the best score, the leftmost at ties, until none is left. With dropout a candidate is skipped if a
hash of (seed, document, first character, middle, last character) falls below the rate: the decision
belongs to the candidate, so it does not depend on how work is split, and runs repeat exactly, while
equal words at other places are segmented in other ways. Rate 0 gives the library's own encoding.

Pieces hold a space mark at their start only, so a text falls into chunks (spaces and what follows)
that are encoded independently: numpy runs the agendas of some 100,000 chunks side by side, one
merge a chunk and step, with each pair's piece found in a two-choice hash table. Chunks of more than
LONG symbols take a heap instead. Texts are encoded in groups of some 2 * WINDOW characters, so memory
grows with the longest single text (about 60 bytes a character), not with the batch.

Decoding is lossless for every text: characters without a piece, and a literal U+2581, are written
as byte pieces; the space put before a text is taken off again.

Defined cases: a null or empty text has no tokens; a null doc_id has a key of its own; repeated rows
give equal rows; an empty table gives no rows; other columns are ignored by :func:`encode_documents`.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, text_of

#: The vocabulary file: a parameter of every entry point. It is read on the driver and broadcast (0.5 MB).
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
RATE, SEED = 0.1, 42
SPACE, NONE = "▁", 1 << 30
LONG, WINDOW = 192, 1 << 16
#: Ranks take 20 bits of a table entry, and pairs of pieces the other 43.
MAX_PIECES = 1 << 20
SCHEMA = "doc_id long, n_tokens long, tokens array<int>, lossless boolean"
_M1, _M2, _M3, _M4 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


class Vocabulary:
    """Pieces, and the table (left piece, right piece) -> rank of the merged piece."""

    def __init__(self, proto: bytes):
        model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = self.size = model.get_piece_size()
        if n > MAX_PIECES:
            raise ValueError(f"a vocabulary of {n} pieces: at most {MAX_PIECES} fit the table of pairs")
        pieces = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        ids = {pieces[i]: i for i in plain}
        self.char = np.full(0x110000, -1, np.int32)
        for piece, i in ids.items():
            if len(piece) == 1:
                self.char[ord(piece)] = i
        self.byte = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        ranked = sorted(plain, key=lambda i: (-model.get_score(i), i))
        self.piece_of = np.array(ranked, np.int32)
        rank = {i: r for r, i in enumerate(ranked)}
        self.text = [p.replace(SPACE, " ").encode() for p in pieces]
        for b, i in enumerate(self.byte):
            self.text[i] = bytes([b])
        pairs = {}
        for piece, i in ids.items():
            for at in range(1, len(piece)):
                left, right = ids.get(piece[:at]), ids.get(piece[at:])
                if left is not None and right is not None:
                    pairs[left * n + right] = rank[i]
        self._build(pairs)

    def _build(self, pairs: dict[int, int]) -> None:
        """Two-choice (cuckoo) table: each key (left * size + right) lies in one of two slots, as key << 20 | rank."""
        bits = max(8, (4 * len(pairs)).bit_length() - 1)
        while True:
            self.bits, slots = bits, [-1] * (2 << bits)
            if all(self._put(slots, key << 20 | r) for key, r in pairs.items()):
                break
            bits += 1
        self.slots = np.array(slots, np.int64)

    def _two(self, key: int) -> tuple[int, int]:
        low = (key ^ (key >> 32) * 0xC2B2AE35) & 0xFFFFFFFF
        return (low * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - self.bits), (1 << self.bits) + ((low * 0x85EBCA6B & 0xFFFFFFFF) >> (32 - self.bits))

    def _put(self, slots: list[int], entry: int) -> bool:
        at = self._two(entry >> 20)[0]
        for _ in range(200):
            slots[at], entry = entry, slots[at]
            if entry < 0:
                return True
            a, b = self._two(entry >> 20)
            at = b if at == a else a
        return False

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the piece that each pair makes, NONE if there is none (or a symbol is no piece)."""
        key = left.astype(np.int64) * self.size + right
        low = (key ^ (key >> 32) * 0xC2B2AE35).astype(np.uint32) if self.size > 1 << 16 else key.astype(np.uint32)
        shift = np.uint32(32 - self.bits)
        entry = self.slots[(low * np.uint32(0x9E3779B1)) >> shift]
        other = np.flatnonzero(entry >> 20 != key)
        second = self.slots[(1 << self.bits) + ((low[other] * np.uint32(0x85EBCA6B)) >> shift).astype(np.int64)]
        found = (entry & 0xFFFFF).astype(np.int32)
        found[other] = np.where(second >> 20 == key[other], second & 0xFFFFF, NONE)
        found[(left < 0) | (right < 0)] = NONE
        return found


@functools.lru_cache(maxsize=2)
def _vocabulary(proto: bytes) -> Vocabulary:
    return Vocabulary(proto)


def document_key(doc_id: int | None, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{seed}:{doc_id}".encode(), digest_size=8).digest(), "little")


def _kept(key: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray, limit: np.uint64) -> np.ndarray:
    """Whether each candidate escapes the dropout."""
    h = key ^ (start.astype(np.uint64) * _M1 + middle.astype(np.uint64) * _M2 + end.astype(np.uint64) * _M3)
    h = (h ^ (h >> np.uint64(31))) * _M4
    h = (h ^ (h >> np.uint64(29))) * _M1
    return (h ^ (h >> np.uint64(32))) >= limit


def _agenda(v: Vocabulary, symbols: list[int], start: int, key: int, limit: np.uint64) -> list[tuple[int, int]]:
    """(position, piece) of one long chunk, by a heap; the same rules as in _side_by_side."""
    n = len(symbols)
    before, after, ends = list(range(-1, n - 1)), [*range(1, n), -1], list(range(start + 1, start + n + 1))
    alive, heap = [True] * n, []
    key_array = np.array([key], np.uint64)

    def offer(lefts: list[int]) -> None:
        lefts = [i for i in lefts if i >= 0 and after[i] >= 0]
        if not lefts:
            return
        rights = [after[i] for i in lefts]
        ranks = v.ranks(np.array([symbols[i] for i in lefts], np.int32), np.array([symbols[j] for j in rights], np.int32))
        a, m, e = (np.array(x, np.int64) for x in ([start + i for i in lefts], [ends[i] for i in lefts], [ends[j] for j in rights]))
        ok = (ranks < NONE) & _kept(key_array, a, m, e, limit)
        for k in np.flatnonzero(ok):
            heapq.heappush(heap, (int(ranks[k]), lefts[k], rights[k], symbols[lefts[k]], symbols[rights[k]]))

    offer(list(range(n - 1)))
    while heap:
        rank, i, j, a, b = heapq.heappop(heap)
        if not (alive[i] and alive[j] and after[i] == j and symbols[i] == a and symbols[j] == b):
            continue
        symbols[i], alive[j], ends[i], after[i] = int(v.piece_of[rank]), False, ends[j], after[j]
        if after[j] >= 0:
            before[after[j]] = i
        offer([before[i], i])
    return [(start + i, symbols[i]) for i in range(n) if alive[i]]


def _side_by_side(v: Vocabulary, symbol: np.ndarray, start: np.ndarray, word: np.ndarray, chunk_end: np.ndarray, origin: np.ndarray, key: np.ndarray, out: np.ndarray, limit: np.uint64) -> None:
    """Merges all chunks at once; results go to out[start].

    symbol, start (place in the batch) and word (number of the chunk) hold a value for each symbol;
    chunk_end, origin (where the document starts) and key hold one for each chunk.
    """

    def candidates(i: np.ndarray) -> np.ndarray:
        """Ranks of the pairs (i, i + 1), NONE across chunks and for dropped candidates."""
        ranks = v.ranks(symbol[i], symbol[i + 1])
        ranks[word[i] != word[i + 1]] = NONE
        hit = np.flatnonzero(ranks < NONE)
        at = i[hit]
        w = word[at]
        after = np.minimum(at + 2, len(symbol) - 1)
        end = np.where((at + 2 < len(symbol)) & (word[after] == w), start[after], chunk_end[w])
        o = origin[w]
        ranks[hit[~_kept(key[w], start[at] - o, start[at + 1] - o, end - o, limit)]] = NONE
        return ranks

    rank = np.full(len(symbol), NONE, np.int32)
    if len(symbol) > 1:
        rank[:-1] = candidates(np.arange(len(symbol) - 1))
    while len(symbol):
        starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        best = np.minimum.reduceat(rank, starts)
        sizes = np.diff(np.append(starts, len(symbol)))
        going = best < NONE
        if not going.all():  # chunks without candidates are done
            stay = np.repeat(going, sizes)
            done = ~stay
            out[start[done]] = symbol[done]
            symbol, start, word, rank = symbol[stay], start[stay], word[stay], rank[stay]
            best, sizes = best[going], sizes[going]
            if not len(symbol):
                return
        at = np.flatnonzero(rank == np.repeat(best, sizes))
        at = at[np.concatenate(([True], word[at[1:]] != word[at[:-1]]))]  # the leftmost of each chunk
        symbol[at] = v.piece_of[best]
        keep = np.ones(len(symbol), bool)
        keep[at + 1] = False
        moved = at - np.arange(len(at))  # where the merged symbols are afterwards
        symbol, start, word, rank = symbol[keep], start[keep], word[keep], rank[keep]
        again = np.concatenate((moved, moved - 1))
        rank[moved] = NONE
        again = again[(again >= 0) & (again < len(symbol) - 1)]
        if len(again):
            rank[again] = candidates(again)


def encode(v: Vocabulary, texts: list[str], keys: list[int], rate: float = RATE) -> list[np.ndarray]:
    """The pieces of each text."""
    limit = np.uint64(min(int(rate * 2.0**64), 2**64 - 1))
    with_mark = [" " + t if t else "" for t in texts]
    codes = np.frombuffer("".join(with_mark).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t) for t in with_mark], np.int64)
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    if not len(codes):
        return [np.empty(0, np.int32) for _ in texts]
    symbol = v.char[codes]
    space = codes == 32
    symbol[space] = v.char[ord(SPACE)]
    symbol[codes == ord(SPACE)] = -1
    bare = symbol < 0
    first = np.zeros(len(codes), bool)
    first[offsets[:-1][lengths > 0]] = True
    first[1:] |= (space[1:] & ~space[:-1]) | bare[1:] | bare[:-1]
    starts = np.flatnonzero(first)
    sizes = np.diff(np.append(starts, len(codes)))
    document = np.repeat(np.arange(len(texts)), lengths)
    key_of = np.array(keys, np.uint64)
    out = np.full(len(codes), -1, np.int32)
    single = sizes == 1
    out[starts[single]] = symbol[starts[single]]
    for s, n in zip(starts[sizes > LONG], sizes[sizes > LONG], strict=True):
        d = document[s]
        for p, piece in _agenda(v, symbol[s : s + n].tolist(), int(s - offsets[d]), int(key_of[d]), limit):
            out[offsets[d] + p] = piece
    short = np.flatnonzero((sizes > 1) & (sizes <= LONG))
    cuts = np.searchsorted(np.cumsum(sizes[short]), np.arange(WINDOW, int(sizes[short].sum()) + WINDOW, WINDOW)) + 1
    low = 0
    for high in np.unique(np.minimum(cuts, len(short))):
        part = short[low:high]
        low = high
        if not len(part):
            continue
        n = sizes[part]
        word = np.repeat(np.arange(len(part), dtype=np.int32), n)
        index = np.repeat(starts[part] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        d = document[starts[part]]
        _side_by_side(v, symbol[index], index, word, starts[part] + n, offsets[d], key_of[d], out, limit)
    return _with_bytes(v, out, bare, codes, lengths)


def _with_bytes(v: Vocabulary, out: np.ndarray, bare: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """Each text's pieces, with bytes for characters that have no piece."""
    c = codes.astype(np.int64)
    n = np.where(bare, 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000), (out >= 0).astype(np.int64))
    ends = np.cumsum(n)
    tokens = np.empty(int(ends[-1]), np.int32)
    plain = (out >= 0) & ~bare
    tokens[ends[plain] - 1] = out[plain]
    at = np.flatnonzero(bare)
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0], np.int64)
    for k in range(4):  # k-th byte from the end
        some = at[n[at] > k]
        byte = np.where(n[some] == 1, c[some], np.where(k == n[some] - 1, lead[n[some]] | (c[some] >> (6 * k)), 0x80 | ((c[some] >> (6 * k)) & 0x3F)))
        tokens[ends[some] - 1 - k] = v.byte[byte]
    text_ends = np.concatenate(([0], np.cumsum(lengths)))
    token_ends = np.concatenate(([0], ends))[text_ends]
    return [tokens[a:b] for a, b in zip(token_ends[:-1], token_ends[1:], strict=True)]


def decode(v: Vocabulary, tokens: np.ndarray) -> str:
    """The text of encode()'s pieces."""
    return b"".join([v.text[i] for i in tokens.tolist()]).decode("utf-8", "surrogatepass")[1:]


def _encoded(batches: Iterator[pa.RecordBatch], proto: bytes, rate: float, seed: int) -> Iterator[pa.RecordBatch]:
    v = _vocabulary(proto)

    def rows(ids: list, texts: list[str]) -> pa.RecordBatch:
        pieces = encode(v, texts, [document_key(i, seed) for i in ids], rate)
        same = [decode(v, p) == t for p, t in zip(pieces, texts, strict=True)]
        ends = np.concatenate(([0], np.cumsum([len(p) for p in pieces]))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*pieces, np.empty(0, np.int32)])))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.diff(ends).astype(np.int64)), lists, pa.array(same, pa.bool_())], names=["doc_id", "n_tokens", "tokens", "lossless"])

    for batch in batches:
        ids, texts, size = [], [], 0
        for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ids.append(doc_id)
            texts.append(text)
            size += len(text)
            if size >= 2 * WINDOW:
                yield rows(ids, texts)
                ids, texts, size = [], [], 0
        if ids:
            yield rows(ids, texts)


def encode_documents(docs: DataFrame, model: str = MODEL, rate: float = RATE, seed: int = SEED) -> DataFrame:
    """doc_id, n_tokens, tokens, and whether they decode to the text, of every row."""
    with open(model, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    return docs.select("doc_id", text_of("text").alias("text")).mapInArrow(lambda it: _encoded(it, shared.value, rate, seed), SCHEMA)


def op5_sentencepiece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read(spark, sf_dir, "documents"))


QUERIES = {"op5_sentencepiece_dropout": op5_sentencepiece_dropout}
