"""Token counts as rollups that signed deltas keep up to date.

A change of the corpus is an insert, a delete or a revision with its counts
before and after. Changes become signed rows (+ after, - before), which add up per
source, language and tokenizer version. A batch of changes is summed, written
under a name of its own, and committed by creating one marker file that names the
folder. The marker can be created only once: a batch that is sent again, by a
retry or by two drivers at once, changes nothing, and a folder whose driver died
before the marker is never read. Totals are the sum over committed folders, which
``compact`` replaces by one.
"""

from __future__ import annotations

import base64
import json
import re
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorelink.llm.common import map_arrow, text_or_empty

KEYS = ["source", "lang", "tokenizer"]
MEASURES = ["docs", "tokens", "chars"]
_SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long, chars long"
_encodings: dict[str, object] = {}


def count_tokens(docs: DataFrame, ranks_path: str, pattern: str, name: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of byte-level BPE tokens of its whole texts; null has none.

    ``ranks_path`` is a file of ranks that the driver reads; ``name`` tells tokenizers apart.
    """
    with open(ranks_path, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    rest = [f for f in docs.schema.fields if f.name not in (out, "_text")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + [f"`{out}` long"])

    def encoding():
        if name not in _encodings:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
            _encodings[name] = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return _encodings[name]

    def run(batch):
        encode = encoding().encode_ordinary
        counts = [len(encode(t)) for t in batch.column("_text").to_pylist()]
        yield pa.record_batch([*(batch.column(f.name) for f in rest), pa.array(counts, pa.int64())], names=[*(f.name for f in rest), out])

    return map_arrow(docs.select(*[f.name for f in rest], text_or_empty(text).alias("_text")), run, schema)


def signed(changes: DataFrame) -> DataFrame:
    """Signed rows of changes with struct columns ``before`` and ``after`` (source, lang, tokenizer, tokens, chars).

    Null ``before``: an insert; null ``after``: a delete; both: a revision; neither: nothing. Null counts are 0.
    """
    sides = F.array(
        *[F.struct(F.lit(sign).cast("long").alias("docs"), *[F.col(f"{side}.{k}").cast("string").alias(k) for k in KEYS],
                   *[(F.coalesce(F.col(f"{side}.{m}"), F.lit(0)) * sign).cast("long").alias(m) for m in MEASURES[1:]], F.col(side).isNotNull().alias("there"))
          for side, sign in (("before", -1), ("after", 1))]
    )
    return changes.select(F.explode(sides).alias("d")).select("d.*").filter("there").select(*KEYS, *MEASURES)


def _summed(rows: DataFrame) -> DataFrame:
    """Sums per key, keys whose sums are all zero left out. Pre-summed before the shuffle, so hot sources do no harm."""
    sums = rows.groupBy(*KEYS).agg(*[F.sum(m).alias(m) for m in MEASURES])
    return sums.filter(" or ".join(f"{m} != 0" for m in MEASURES))


class Rollup:
    """A rollup kept in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _mark(self, name: str, content: dict) -> bool:
        """Create a marker; False if there is one. A marker whose driver died while writing it is taken over."""
        path, files = self._path(name)
        kind, _, own = name.rpartition("/")
        if files.exists(path):
            if own in self._marks(kind):
                return False
            files.delete(path, False)
        try:
            stream = files.create(path, False)  # fails if another driver was faster
        except Exception:
            if files.exists(path):
                return False
            raise
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        return True

    def _marks(self, kind: str) -> dict[str, dict]:
        """Complete markers by name: as many rows as there are batches since the last base was cleaned."""
        path, files = self._path(kind)
        if not files.exists(path):
            return {}
        rows = self.spark.read.text(f"{self.folder}/{kind}", wholetext=True).select(F.input_file_name().alias("file"), "value").collect()
        return {r.file.rpartition("/")[2]: json.loads(r.value) for r in rows if r.value.endswith("}")}

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of changes once; False if it was committed before."""
        if not re.fullmatch(r"[A-Za-z0-9-]+", batch):
            raise ValueError("batch names are letters, digits and -")
        if batch in self._marks("commits"):
            return False
        name = f"deltas/{batch}-{uuid4().hex}"
        _summed(signed(changes)).write.parquet(f"{self.folder}/{name}")
        if self._mark(f"commits/{batch}", {"folder": name}):
            return True
        self._drop(name)
        return False

    def _drop(self, name: str) -> None:
        path, files = self._path(name)
        files.delete(path, True)

    def _state(self) -> tuple[dict, dict[str, dict], int]:
        """The latest base, all committed batches and the number of bases, from one look at the markers."""
        bases = self._marks("bases")
        base = bases[max(bases)] if bases else {"folder": None, "batches": []}
        return base, self._marks("commits"), len(bases)

    def _totals(self, base: dict, commits: dict[str, dict]) -> DataFrame:
        new = [m["folder"] for b, m in sorted(commits.items()) if b not in set(base["batches"])]
        folders = [f"{self.folder}/{f}" for f in [base["folder"], *new] if f]
        if not folders:
            return self.spark.createDataFrame([], _SCHEMA)
        return _summed(self.spark.read.schema(_SCHEMA).parquet(*folders))

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens, chars): the sum of all that is committed; nothing yet gives no rows."""
        base, commits, _ = self._state()
        return self._totals(base, commits)

    def compact(self) -> None:
        """Write the totals as a new base; readers see the old or the new one, with the same sums.

        The base names the batches it was made from; one that is committed meanwhile is in neither and counts by its own delta.
        """
        base, commits, number = self._state()
        name = f"totals/{uuid4().hex}"
        self._totals(base, commits).write.parquet(f"{self.folder}/{name}")
        if not self._mark(f"bases/{number:08d}", {"folder": name, "batches": sorted({*base["batches"], *commits})}):
            self._drop(name)
