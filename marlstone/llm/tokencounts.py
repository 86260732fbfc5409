"""Token counts as a delta-maintained rollup.

A store is a folder. A batch writes the signed changes of its documents (a row of -1 for what a document
counted before, one of +1 for what it counts now) and their sums by source, language and tokenizer version;
a numbered entry in the log then makes them count. Entries are renamed into place where none with that number
is, so a commit happens once: repeating it changes nothing, and of two writers the later one sees the other's
entry and works out its changes again. Every ``COMPACT`` entries the state of all documents and the totals
are written as a snapshot; readers take the last one and the entries after it, so neither totals nor a commit
depend on how long the history is.
"""

from __future__ import annotations

import base64
import json
import os
import re
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.pieces import TOKENIZERS
from marlstone.session import materialise, release, shared_dir, table

#: Tokenizer versions: the vocabulary files counted by default.
VERSIONS = ("byte_bpe_50k", "byte_bpe_multi_50k")
#: The split of byte-level BPE into pieces that are encoded alone.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose counts a task remembers.
MEMO_WORDS = 400_000

#: Log entries after which a snapshot is written.
COMPACT = 16

KEYS = ["source", "lang", "version"]
SUMS = "source string, lang string, version string, n_docs long, n_tokens long"
STATE = f"doc_id long, {SUMS}"

#: White space that a cut before each space could split otherwise than the pattern does.
_RUN = re.compile(r"\s(?: \s| \Z)| {2}")


def vocabularies(versions: tuple[str, ...] = VERSIONS, folder: str = TOKENIZERS) -> dict[str, bytes]:
    """The contents of the vocabulary files, by version."""
    found = {}
    for v in versions:
        with open(os.path.join(folder, f"{v}.tiktoken"), "rb") as f:
            found[v] = f.read()
    return found


class Counter:
    """Token counts of texts under several byte-level BPE vocabularies.

    A text is cut before each space; no token reaches over such a cut unless white space runs on, and
    those texts are encoded whole. Words are counted once and remembered.
    """

    def __init__(self, vocabularies: dict[str, bytes]):
        import tiktoken

        self.encodings = []
        for v, content in vocabularies.items():
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
            self.encodings.append(tiktoken.Encoding(v, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}))
        self.memo: dict[str, int] = {}
        self.counts = np.zeros((1, len(vocabularies)), np.int64)
        self.grown: list[tuple[int, ...]] = []

    def whole(self, text: str) -> tuple[int, ...]:
        return tuple(len(e.encode_ordinary(text)) for e in self.encodings)

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text (rows) under each version (columns); a null text has none."""
        if len(self.memo) > MEMO_WORDS:
            self.memo, self.counts = {}, self.counts[:1]
        memo, out = self.memo, np.zeros((len(texts), len(self.encodings)), np.int64)
        numbers: list[int] = []
        sizes = np.zeros(len(texts), np.int64)
        grown: list[tuple[int, ...]] = []
        base = len(self.counts)
        for r, text in enumerate(texts):
            if not text:
                continue
            if _RUN.search(text):
                out[r] = self.whole(text)
                continue
            words = text.split(" ")
            try:
                mine = [memo[w] for w in words[1:]]
            except KeyError:
                mine = []
                for w in words[1:]:
                    k = memo.get(w)
                    if k is None:
                        k = memo[w] = base + len(grown)
                        grown.append(self.whole(" " + w))
                    mine.append(k)
            numbers += mine
            sizes[r] = len(mine)
            out[r] = self.whole(words[0]) if words[0] else 0
        if grown:
            self.counts = np.concatenate([self.counts, np.array(grown, np.int64)])
        if numbers:
            total = np.concatenate([np.zeros((1, out.shape[1]), np.int64), np.cumsum(self.counts[numbers], axis=0)])
            end = np.cumsum(sizes)
            out += total[end] - total[end - sizes]
        return out


def count_tokens(docs: DataFrame, versions: tuple[str, ...] = VERSIONS, folder: str = TOKENIZERS) -> DataFrame:
    """doc_id, source, lang, version, n_tokens: a row for each row of ``docs`` and version.

    Null and empty texts have 0 tokens, texts of any length are counted whole, repeated rows each count. Further
    columns are ignored; an empty table gives an empty result. The driver reads the vocabularies and sends them along.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabularies(versions, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for b in batches:
            for lo in range(0, len(b), 1000):
                part = b.slice(lo, 1000)
                n = counter.count(part.column(3).to_pylist())
                for c, v in enumerate(versions):
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array([v] * len(part)), pa.array(n[:, c])], names=["doc_id", "source", "lang", "version", "n_tokens"])

    return docs.select("doc_id", "source", "lang", "text").mapInArrow(run, "doc_id long, source string, lang string, version string, n_tokens long")


def _summed(rows: DataFrame, *keys: str) -> DataFrame:
    out = rows.groupBy(*keys).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    return out.where("n_docs <> 0 or n_tokens <> 0")


class Rollup:
    """The store in a folder; see the module's text."""

    def __init__(self, spark: SparkSession, folder: str, versions: tuple[str, ...] = VERSIONS, tokenizers: str = TOKENIZERS, compact: int = COMPACT):
        self.spark, self.folder, self.versions, self.tokenizers, self.compact_every = spark, folder.rstrip("/"), versions, tokenizers, compact
        self._jvm = spark.sparkContext._jvm
        hadoop = self._jvm.org.apache.hadoop
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._path = hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(conf)
        self._context = hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        self._no_overwrite = spark.sparkContext._gateway.new_array(hadoop.fs.Options.Rename, 0)

    def _names(self, what: str) -> list[str]:
        home = self._path(f"{self.folder}/{what}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(home)) if self._fs.exists(home) else []

    def _publish(self, aside: str, final: str) -> bool:
        """Rename what was written aside to its place; False if something is there already."""
        self._fs.mkdirs(self._path(final).getParent())
        try:
            self._context.rename(self._path(aside), self._path(final), self._no_overwrite)
            return True
        except Py4JJavaError:
            if not self._fs.exists(self._path(final)):
                raise
            self._fs.delete(self._path(aside), True)
            return False

    def log(self) -> tuple[int, list[dict]]:
        """The number of the last snapshot (0: none), and the entries after it in order."""
        snapshots = self._names("snapshots")
        base = int(snapshots[-1]) if snapshots else 0
        entries = []
        for name in self._names("log"):
            if int(name) > base:
                stream = self._fs.open(self._path(f"{self.folder}/log/{name}"))
                entries.append(json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
                stream.close()
        return base, entries

    def committed(self, batch: str) -> bool:
        """Whether the batch is in the store."""
        return self._fs.exists(self._path(f"{self.folder}/names/{batch}")) or any(e["batch"] == batch for e in self.log()[1])

    def _parts(self, what: str, schema: str, log: tuple[int, list[dict]]) -> tuple[DataFrame, DataFrame]:
        """Rows of the snapshot and of the later batches."""
        base, entries = log
        at = [f"{self.folder}/snapshots/{base:09d}/{what}"] if base else []
        read = lambda paths: self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return read(at), read([f"{self.folder}/data/{e['data']}/{what}" for e in entries])

    def state(self, log: tuple[int, list[dict]] | None = None, ids: DataFrame | None = None) -> DataFrame:
        """doc_id, source, lang, version, n_docs, n_tokens that each document (of ``ids``, if given) counts now."""
        rows = None
        for part in self._parts("state", STATE, log or self.log()):
            part = part if ids is None else part.join(ids, "doc_id", "left_semi")
            rows = part if rows is None else rows.unionByName(part)
        return _summed(rows, "doc_id", *KEYS)

    def totals(self, log: tuple[int, list[dict]] | None = None) -> DataFrame:
        """source, lang, version, n_docs, n_tokens; groups that hold no document are left out, an empty store has none."""
        before, after = self._parts("sums", SUMS, log or self.log())
        return _summed(before.unionByName(after), *KEYS)

    def destroy(self) -> None:
        """Delete the store."""
        self._fs.delete(self._path(self.folder), True)

    def compact(self) -> None:
        """Write the state and the totals as of the last entry as a snapshot."""
        log = self.log()
        if not log[1]:
            return
        last = log[0] + len(log[1])
        aside = f"{self.folder}/aside/snapshot-{uuid.uuid4().hex}"
        self.state(log).write.parquet(f"{aside}/state")
        self.totals(log).write.parquet(f"{aside}/sums")
        for e in log[1]:  # names of batches that readers of the snapshot no longer find in the log
            self._fs.mkdirs(self._path(f"{self.folder}/names/{e['batch']}"))
        self._publish(aside, f"{self.folder}/snapshots/{last:09d}")

    def commit(self, batch: str, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> bool:
        """Apply inserted or revised documents and deleted doc_ids; False if the batch was committed before.

        An upsert whose doc_id counts already is a revision: its old counts are taken back. Rows of one
        batch that share a doc_id all count together; a null doc_id always adds. A deleted doc_id that does
        not count, or is null, changes nothing; one that is also upserted is a revision. Null source or
        lang is a group of its own. Null and empty texts count as documents without tokens; empty tables change
        nothing; further columns are ignored. Between batches there are no ties: the later entry counts.
        """
        if not re.fullmatch(r"[A-Za-z0-9_-]+", batch):
            raise ValueError(f"batch name {batch!r}: letters, digits, _ and - only")
        if self.committed(batch):
            return False
        plus, gone = None, []
        if upserts is not None:
            now = count_tokens(upserts, self.versions, self.tokenizers)
            now = now.groupBy("doc_id", *KEYS).agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
            plus = materialise(self.spark, now, "counts")  # once, also if another writer's entry makes this one start again
            gone.append(upserts.select("doc_id"))
        if deletes is not None:
            gone.append(deletes.select("doc_id"))
        ids = reduce(DataFrame.unionByName, gone).where("doc_id is not null").distinct() if gone else None
        while True:
            log = self.log()
            data = f"{batch}-{uuid.uuid4().hex}"
            out = f"{self.folder}/data/{data}"
            changes = self.spark.createDataFrame([], STATE) if plus is None else plus.select("doc_id", *KEYS, "n_docs", "n_tokens")
            if ids is not None and (log[0] or log[1]):
                minus = self.state(log, ids)
                changes = changes.unionByName(minus.select("doc_id", *KEYS, *((-F.col(c)).alias(c) for c in ("n_docs", "n_tokens"))))
            changes.write.parquet(f"{out}/state")
            _summed(self.spark.read.schema(STATE).parquet(f"{out}/state"), *KEYS).write.parquet(f"{out}/sums")
            aside = f"{self.folder}/aside/{data}"
            stream = self._fs.create(self._path(aside), False)
            stream.write(json.dumps({"batch": batch, "data": data}).encode())
            stream.close()
            done = self._publish(aside, f"{self.folder}/log/{log[0] + len(log[1]) + 1:09d}")
            if done or self.committed(batch):
                break
        release(plus)
        if not done:
            self._fs.delete(self._path(out), True)
        elif len(log[1]) + 1 >= self.compact_every:
            self.compact()
        return done


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a store that all documents are committed to.

    After the load, which is sent twice, one batch revises a twentieth of the documents and deletes another,
    and a third one puts both back as they were: the totals are those of the whole table.
    """
    store = Rollup(spark, f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(20))
    store.commit("load-1", docs)
    store.commit("load-1", docs)
    store.commit("revise-1", docs.where(part == 0).withColumn("text", F.concat("text", F.lit(" revised"))), docs.where(part == 1).select("doc_id"))
    store.commit("restore-1", docs.where(part <= 1))
    totals = materialise(spark, store.totals(), "totals")
    store.destroy()
    return totals
