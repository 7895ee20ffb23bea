"""Token counts per source, language and tokenizer version, kept up to date by deltas.

A change row says that a document entered (+1), left (-1) or, as a pair of both, was revised.
A batch of changes is summed to signed totals per (source, lang, tokenizer) before its shuffle,
and committed under a batch id. Totals are sums of committed deltas, so they are additive and
batches may come in any order. A commit is idempotent: the delta of a batch is written under its
id and counts once its writer's success mark is there; a batch that was committed is not applied
again, one whose writer was lost is written over. ``compact`` folds deltas into a snapshot, which
names the batches it holds.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = ("source", "lang", "tokenizer")
DELTA = "source string, lang string, tokenizer string, docs long, tokens long"
#: Fixed value: the rule by which byte-level BPE cuts a text into pieces.
PIECES = (
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
)
#: Texts are cut in front of white space into pieces of about this many characters, so that
#: encoding needs no memory for a whole text's tokens.
PIECE = 1 << 16


def read_ranks(path: str) -> bytes:
    """A vocabulary file in tiktoken's form: a line per token, base64 and rank. It is a file of
    fixed size (about 1 MB) on the driver, and goes to tasks with their code."""
    with open(path, "rb") as file:
        return file.read()


class Tokens:
    """Counts tokens of texts. Equal lists of tokens as for the text in one piece: pieces end
    where a word ends and white space begins with one blank, where the tokenizer cuts anyway."""

    def __init__(self, ranks: bytes):
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding(
            "own", pat_str=PIECES, mergeable_ranks=table, special_tokens={}
        )
        self.edge = re.compile(r"(?<=\w) (?=\w)")

    def pieces(self, text: str) -> Iterator[str]:
        start = 0
        while len(text) - start > PIECE:
            edge = self.edge.search(text, start + PIECE)
            if not edge:
                break
            yield text[start : edge.start()]
            start = edge.start()
        yield text[start:]

    def count(self, text: str | None) -> int:
        return sum(len(self.encoding.encode_ordinary(p)) for p in self.pieces(text or ""))


def count_tokens(docs: DataFrame, ranks: bytes, version: str) -> DataFrame:
    """(doc_id, source, lang, tokenizer, tokens) of every row of ``docs``, whole texts; a null
    text has 0 tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(ranks)
        for batch in batches:
            texts = batch.column(3)
            counts = [tokens.count(texts[i].as_py()) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(counts, pa.int64())], ["doc_id", "source", "lang", "tokens"]
            )

    light = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("source", "lang", "text"))
    )
    counted = light.mapInArrow(run, "doc_id long, source string, lang string, tokens long")
    return counted.select("doc_id", "source", "lang", F.lit(version).alias("tokenizer"), "tokens")


def inserts(counted: DataFrame) -> DataFrame:
    return counted.select(*KEYS, F.lit(1).alias("sign"), "tokens")


def deletes(counted: DataFrame) -> DataFrame:
    return counted.select(*KEYS, F.lit(-1).alias("sign"), "tokens")


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes that turn ``before`` into ``after``: counts of documents as they were and are.
    A document whose source, language, version or count changed leaves and enters."""
    return deletes(before).union(inserts(after))


class Rollup:
    """Totals at ``path``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, pattern: str) -> list[str]:
        path, files = self._folder(f"{pattern}/_SUCCESS")
        return sorted(x.getPath().getParent().getName() for x in files.globStatus(path) or [])

    def _snapshot(self) -> tuple[str | None, set[str]]:
        """The newest complete snapshot and the batches in it."""
        names = self._names("snapshot-*")
        if not names:
            return None, set()
        held = self.spark.read.text(f"{self.path}/holds-{names[-1]}").collect()
        return names[-1], {r.value for r in held}

    def committed(self) -> set[str]:
        """Ids of the batches that count."""
        return {n.removeprefix("batch-") for n in self._names("batch-*")} | self._snapshot()[1]

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply signed ``changes`` (source, lang, tokenizer, sign, tokens) under the id
        ``batch`` (letters, digits, dots, dashes). False, and no effect, if it was applied.

        A null token count is 0, a null sign counts as no change; null keys are a group of
        their own; an empty batch is committed as such."""
        if not re.fullmatch(r"[A-Za-z0-9.-]+", batch):
            raise ValueError(f"not a batch id: {batch!r}")
        if batch in self.committed():
            return False
        sign = F.coalesce(F.col("sign"), F.lit(0)).cast("long")
        delta = changes.groupBy(*KEYS).agg(
            F.sum(sign).alias("docs"),
            F.sum(sign * F.coalesce(F.col("tokens"), F.lit(0))).cast("long").alias("tokens"),
        )
        delta.coalesce(8).write.mode("overwrite").parquet(f"{self.path}/batch-{batch}")
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens); groups without documents and tokens are left
        out."""
        snapshot, held = self._snapshot()
        names = [n for n in self._names("batch-*") if n.removeprefix("batch-") not in held]
        folders = [f"{self.path}/{n}" for n in [*([snapshot] if snapshot else []), *names]]
        schema = T._parse_datatype_string(DELTA)
        deltas = (
            self.spark.read.schema(schema).parquet(*folders)
            if folders
            else self.spark.createDataFrame([], schema)
        )
        sums = deltas.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where("docs <> 0 OR tokens <> 0")

    def compact(self) -> None:
        """Fold all committed deltas into a new snapshot. The list of what it holds is written
        first and the snapshot counts when its own success mark is there."""
        ids = sorted(self.committed())
        if not ids:
            return
        name = f"snapshot-{len(self._names('snapshot-*')):08d}"
        listed = self.spark.createDataFrame([(i,) for i in ids], "value string")
        totals = self.totals()
        listed.coalesce(1).write.mode("overwrite").text(f"{self.path}/holds-{name}")
        totals.coalesce(8).write.mode("overwrite").parquet(f"{self.path}/{name}")
