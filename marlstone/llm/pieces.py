"""SentencePiece encoding and decoding of a public BPE model by batched dynamic programming.

A text is cut where no piece can reach across: before each run of spaces and around newlines. The
distinct words of a block advance together, grouped by length: for every end position the substring
hashes of all piece lengths probe the sorted piece keys, and the maximal admissible piece is
stored as the back-pointer. In a model whose segmentation is defined by merges the sum of scores
does not select the right path, so the lattice is restricted instead: a piece may follow the last piece
of the (unique) encoding of the prefix only if merging would leave the two as they are. That leaves one
path, the one the merges give, and the results equal those of the library.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import words as W
from marlstone.session import table

#: Where the public vocabulary files lie; the model is a parameter of the operators.
TOKENIZERS = os.environ.get("MARLSTONE_TOKENIZERS", "/opt/tokenizers")
MODEL = "piece_bpe_32k.model"
SPACE = "▁"
BLOCK_BYTES = 2 << 20
CACHE_WORDS = 1_500_000
#: Fewer words of one length than this are walked through the lattice one by one: arrays would be too short to pay.
FEW_WORDS = 32
#: Pairs of pieces that are looked up one by one before they join the sorted ones.
LATE_PAIRS = 4000

_G = np.uint64(0xD1342543DE82EF95)


class Pieces:
    """The model's pieces, their sorted substring keys, and which pieces may stand side by side."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = np.zeros(256, np.int32)
        normal = []
        for i in range(n):
            if sp.is_byte(i):
                self.bytes[int(self.text[i][3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                normal.append(i)
        self.rank = {self.text[i]: -sp.get_score(i) for i in normal}
        self.id = {self.text[i]: i for i in normal}
        reach = [i for i in normal if len(self.text[i]) == 1 or self.merge(self.text[i]) == [self.text[i]]]
        self.longest = max(len(self.text[i]) for i in reach)
        self.reach = {self.text[i]: i for i in reach}
        rng = np.random.default_rng(11)
        self.table = rng.integers(1, 2**63, 1 << 12, dtype=np.uint64)
        keys = np.array([self.key(self.text[i]) for i in reach], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(reach, np.int32)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a key")
        kinds = set(normal)
        raw = [self.text[i].replace(SPACE, " ").encode() if i in kinds else b"" for i in range(n)]
        for b in range(256):
            raw[self.bytes[b]] = bytes([b])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_len = np.array([len(r) for r in raw], np.int64)
        self.raw_at = np.cumsum(self.raw_len) - self.raw_len
        self.pair_keys, self.pair_ok = np.array([-1]), np.array([False])  # sorted; those met lately are in a dict
        self.late: dict[int, bool] = {}
        self.beside: dict[int, bool] = {}
        self.encoder: Encoder | None = None

    def codes(self, chars: np.ndarray) -> np.ndarray:
        """A random-looking number for each code point."""
        return self.table[chars & 0xFFF] + W.mix(chars.astype(np.uint64) >> np.uint64(12))

    def key(self, text: str) -> np.uint64:
        h = np.zeros(1, np.uint64)
        for c in self.codes(np.array([ord(c) for c in text], np.int64)):
            h = h * _G + c
        return h[0]

    def merge(self, text: str) -> list[str]:
        """The pieces that merging best pairs first, leftmost among equals, leaves of a text."""
        parts, rank, never = list(text), self.rank, float("inf")
        ranks = [rank.get(a + b, never) for a, b in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) < never:
            k = ranks.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del ranks[k]
            if k:
                ranks[k - 1] = rank.get(parts[k - 1] + parts[k], never)
            if k < len(ranks):
                ranks[k] = rank.get(parts[k] + parts[k + 1], never)
        return parts

    def adjacent(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging the text of two pieces leaves just these; an unknown character (-1) stands anywhere."""
        out = (left < 0) | (right < 0)
        ask = np.flatnonzero(~out)
        key = left[ask].astype(np.int64) << 32 | right[ask]
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        ok = self.pair_ok[at]
        new = np.flatnonzero(self.pair_keys[at] != key)
        if len(new):
            late, text = self.late, self.text
            for k in np.unique(key[new]).tolist():
                if k not in late:
                    a, b = text[k >> 32], text[k & 0xFFFFFFFF]
                    late[k] = self.merge(a + b) == [a, b]
            ok[new] = [late[k] for k in key[new].tolist()]
            if len(late) > LATE_PAIRS:
                keys = np.concatenate([self.pair_keys, np.fromiter(late, np.int64)])
                order = np.argsort(keys)
                self.pair_keys, self.pair_ok = keys[order], np.concatenate([self.pair_ok, np.fromiter(late.values(), bool)])[order]
                late.clear()
        out[ask] = ok
        return out

    def segment(self, words: list[str]) -> list[np.ndarray]:
        """Piece ids of each word (spaces already written as the space mark)."""
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(words)
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by.setdefault(len(w), []).append(i)
        for size, who in by.items():
            if size and len(who) < FEW_WORDS:
                for i in who:
                    out[i] = self._walk(words[i])
                continue
            step = max(1, 2_000_000 // (size + 1))
            for s in range(0, len(who) if size else 0, step):
                part = who[s : s + step]
                for i, ids in zip(part, self._advance([words[i] for i in part], size)):
                    out[i] = ids
        return out

    def _walk(self, word: str) -> np.ndarray:
        """The piece ids of one word by the same lattice, in time linear in its length."""
        n, longest, reach, beside = len(word), self.longest, self.reach, self.beside
        last, back = [-1] * (n + 1), [1] * (n + 1)
        if len(beside) > CACHE_WORDS:
            beside.clear()
        for i in range(1, n + 1):
            for length in range(min(i, longest), 0, -1):
                piece = reach.get(word[i - length : i])
                if piece is None:
                    continue
                left = last[i - length]
                if left >= 0:
                    key = left << 32 | piece
                    ok = beside.get(key)
                    if ok is None:
                        a, b = self.text[left], self.text[piece]
                        ok = beside[key] = self.merge(a + b) == [a, b]
                    if not ok:
                        continue
                last[i], back[i] = piece, length
                break
        ids, at = [], n
        while at:
            ids += [last[at]] if last[at] >= 0 else self.bytes[list(word[at - 1].encode())].tolist()[::-1]
            at -= back[at]
        return np.array(ids[::-1], np.int32)

    def _advance(self, words: list[str], size: int) -> Iterator[np.ndarray]:
        n = len(words)
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(n, size).astype(np.int64)
        codes = self.codes(chars)
        prefix = np.zeros((size + 1, n), np.uint64)
        for i in range(size):
            prefix[i + 1] = prefix[i] * _G + codes[:, i]
        power = np.ones(self.longest + 1, np.uint64)
        np.multiply.accumulate(np.full(self.longest, _G), out=power[1:])
        last = np.full((size + 1, n), -1, np.int32)
        back = np.zeros((size + 1, n), np.int16)
        for i in range(1, size + 1):
            open_ = np.arange(n)
            for length in range(min(i, self.longest), 0, -1):  # the longest first: its maximum is the back-pointer
                h = prefix[i][open_] - prefix[i - length][open_] * power[length]
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                hit = np.flatnonzero(self.keys[at] == h)
                if len(hit):
                    who, piece = open_[hit], self.ids[at[hit]]
                    if length < i:
                        ok = self.adjacent(last[i - length][who], piece)
                        who, piece = who[ok], piece[ok]
                    last[i][who], back[i][who] = piece, length
                    open_ = open_[back[i][open_] == 0]
                if not len(open_):
                    break
            back[i][open_] = 1  # a character without a piece
        ids = np.empty((n, size), np.int32)
        count = np.zeros(n, np.int64)
        at = np.full(n, size)
        who = np.arange(n)
        while len(who):
            ids[who, size - 1 - count[who]] = last[at[who], who]
            count[who] += 1
            at[who] -= back[at[who], who]
            who = who[at[who] > 0]
        for r in range(n):
            mine = ids[r, size - count[r] :]
            if mine.min() >= 0:
                yield mine
            else:  # characters without a piece become their bytes
                pos, parts = 0, []
                for p in mine.tolist():
                    if p >= 0:
                        parts.append(np.array([p], np.int32))
                        pos += len(self.text[p])
                    else:
                        parts.append(self.bytes[np.frombuffer(words[r][pos].encode(), np.uint8)])
                        pos += 1
                yield np.concatenate(parts)


class Encoder:
    """Encodes blocks of texts; keeps the pieces of words seen before."""

    def __init__(self, pieces: Pieces):
        self.p = pieces
        self._clear()

    def _clear(self) -> None:
        self.hash, self.at, self.n = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.pool, self.used = np.empty(1 << 20, np.int32), 0

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        ids = self.p.segment(words)
        n = np.array([len(i) for i in ids], np.int64)
        total = int(n.sum())
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        self.pool[self.used : self.used + total] = np.concatenate(ids)
        where = np.searchsorted(self.hash, hashes)  # both are sorted
        self.hash = np.insert(self.hash, where, hashes)
        self.at = np.insert(self.at, where, self.used + np.cumsum(n) - n)
        self.n = np.insert(self.n, where, n)
        self.used += total

    def block(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of each row's ids) for texts that each begin with the added space."""
        space, line = buf == 32, buf == 10
        begin = line.copy()
        begin[1:] |= line[:-1] | (space[1:] & ~space[:-1])
        begin[off[:-1][off[:-1] < off[1:]]] = True
        s = np.flatnonzero(begin)
        e = np.append(s[1:], len(buf))
        h = W.span_hash(buf, s, e)
        kinds, first, which = np.unique(h, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hash, kinds), max(0, len(self.hash) - 1))
        new = np.flatnonzero(self.hash[at] != kinds) if len(self.hash) else np.arange(len(kinds))
        if len(new):
            if len(self.hash) + len(new) > CACHE_WORDS:
                self._clear()
                new = np.arange(len(kinds))
            raw = buf.tobytes()
            self._learn(kinds[new], [raw[a:b].decode().replace(" ", SPACE) for a, b in zip(s[first[new]].tolist(), e[first[new]].tolist())])
            at = np.searchsorted(self.hash, kinds)
        n = self.n[at][which]
        end = np.cumsum(n)
        ids = self.pool[np.repeat(self.at[at][which] - (end - n), n) + np.arange(int(end[-1]) if len(end) else 0)]
        cut = np.searchsorted(s, off)
        return ids, np.concatenate([[0], end])[cut]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a sequence of ids, the added space included."""
        n = self.p.raw_len[ids]
        end = np.cumsum(n)
        return self.p.raw[np.repeat(self.p.raw_at[ids] - (end - n), n) + np.arange(int(end[-1]) if len(end) else 0)]


def encoder_of(pieces: Pieces) -> Encoder:
    """The encoder of a task's process: what it has learned serves later tasks too."""
    pieces.encoder = pieces.encoder or Encoder(pieces)
    return pieces.encoder


def spaced_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks of texts with a space before each, except before empty ones, which stay empty."""
    import pyarrow.compute as pc

    column = pc.replace_substring(pc.fill_null(column.cast(pa.large_string()), ""), SPACE, " ")
    kind = pa.large_string()
    led = pc.binary_join_element_wise(pa.scalar("", kind), column, pa.scalar(" ", kind))
    column = pc.if_else(pc.equal(column, ""), column, led)
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def model_path(name: str = MODEL) -> str:
    return os.path.join(TOKENIZERS, name)


def encode_documents(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip of every row.

    ids are those of the library's ``encode``. round_trip tells that decoding the ids gave the text
    back, byte for byte (a space mark U+2581 in a text counts as the space that it decodes to). A null
    text has null n_tokens, ids and round_trip; an empty one has no ids. Null doc_ids and repeated rows
    are encoded like any other; further columns are ignored; an empty table gives an empty result. Texts and
    words of any length are encoded whole, in time linear in their length. There are no ties: each prefix of a
    word has one admissible last piece.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Pieces(model or model_path()))
    kind = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared.value)
        for batch in batches:
            null = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            for lo, hi, buf, off in spaced_blocks(batch.column(1)):
                if len(buf):
                    ids, cut = encoder.block(buf, off)
                else:
                    ids, cut = np.empty(0, np.int32), np.zeros(hi - lo + 1, np.int64)
                again = encoder.decode(ids)
                if np.array_equal(again, buf):
                    same = np.ones(hi - lo, bool)
                else:
                    same = np.array([np.array_equal(encoder.decode(ids[cut[r] : cut[r + 1]]), buf[off[r] : off[r + 1]]) for r in range(hi - lo)])
                gone = null[lo:hi]
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids), mask=pa.array(gone))
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(np.diff(cut).astype(np.int32), mask=gone), lists.cast(kind), pa.array(same, mask=gone)], names=["doc_id", "n_tokens", "ids", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(W.lean(run), "doc_id long, n_tokens int, ids array<int>, round_trip boolean")


def decode_ids(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, text of rows (doc_id, ids): the library's ``decode``. Null ids give a null text; bytes that
    are no UTF-8 become replacement characters; ids outside the vocabulary raise."""
    shared = encoded.sparkSession.sparkContext.broadcast(Pieces(model or model_path()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared.value)
        for b in batches:
            texts = [None if i is None else encoder.decode(np.array(i, np.int64)).tobytes()[1 if i else 0 :].decode(errors="replace") for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, each decoded again and compared."""
    return encode_documents(table(spark, sf_dir, "documents"))
