"""The chunk store: Parquet tables partitioned by chunk type, and manifests that name those of a version.

An upsert writes a table of the new rows only and commits a manifest that adds it; a reader takes each
chunk from the newest table that has it. After ``MAX_TABLES`` upserts the tables are merged into one, so
writing costs in proportion to what is new, not to the store. A manifest appears under its number by one
rename and never replaces another: of two writers the second reads the first one's version and commits
on top of it. Manifests older than the newest ``KEPT`` go, with the tables that only they name. Only
Hadoop's file system is used, so the store can be anywhere Spark can write; where its rename replaces
files, as on a local disk, two writers must not commit within the same moment.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..schemas import STORE
from ..tables import file_system
from .models import Embedder, hashed_words

MAX_TABLES = 8
KEPT = 8
ATTEMPTS = 20


class ChunkStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = file_system(spark, self.root)[1]

    def versions(self) -> list[str]:
        """Committed versions that are still kept, oldest first."""
        at = self._path(f"{self.root}/_versions")
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(n for n in names if n.isdigit())

    def tables(self, version: str | None) -> list[str]:
        """Names of a version's tables, oldest first."""
        if version is None:
            return []
        stream = self._fs.open(self._path(f"{self.root}/_versions/{version}"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, chunk_type: str | None = None, version: str | None = None) -> DataFrame:
        """The newest version (or the one named); a chunk type prunes to its partitions."""
        found = self.versions()
        return self._merged(self.tables(version or (found[-1] if found else None)), chunk_type)

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.schema(STORE).parquet(f"{self.root}/data/{name}")

    def _merged(self, tables: list[str], chunk_type: str | None = None) -> DataFrame:
        out, newer = None, None
        for name in reversed(tables):
            own = self._table(name)
            rows = own if chunk_type is None else own.filter(F.col("chunk_type") == chunk_type)
            rows = rows if newer is None else rows.join(newer, "chunk_id", "left_anti").select(*STORE.fieldNames())
            out = rows if out is None else out.unionByName(rows)
            ids = own.select("chunk_id")
            newer = ids if newer is None else newer.unionByName(ids)
        return self.spark.createDataFrame([], STORE) if out is None else out

    def upsert(self, chunks: DataFrame) -> str:
        """Rows of new ids and new rows of old ids; of rows that share an id in ``chunks`` the last by text stays."""
        order = F.max_by(F.struct(*STORE.fieldNames()), F.struct("structured_text", "agent_notes"))
        new = self._write(chunks.groupBy("chunk_id").agg(order.alias("r")).select("r.*"))
        for _ in range(ATTEMPTS):
            found = self.versions()
            tables = [*self.tables(found[-1] if found else None), new]
            if len(tables) > MAX_TABLES:
                tables = [self._write(self._merged(tables))]
            name = f"{int(found[-1]) + 1 if found else 0:09d}"
            if self._commit(name, tables):
                self._purge()
                return name
        raise RuntimeError(f"{ATTEMPTS} other writers came first")

    def _write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.write.partitionBy("chunk_type").parquet(f"{self.root}/data/{name}")
        return name

    def _commit(self, name: str, tables: list[str]) -> bool:
        to, draft = self._path(f"{self.root}/_versions/{name}"), self._path(f"{self.root}/_versions/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(json.dumps(tables).encode())
        out.close()
        done = not self._fs.exists(to) and self._fs.rename(draft, to)
        if not done:
            self._fs.delete(draft, False)
        return done

    def _purge(self) -> None:
        found = self.versions()
        held = {t for v in found[-KEPT:] for t in self.tables(v)}
        for v in found[:-KEPT]:
            for t in set(self.tables(v)) - held:
                self._fs.delete(self._path(f"{self.root}/data/{t}"), True)
            self._fs.delete(self._path(f"{self.root}/_versions/{v}"), False)


def storable(chunks: DataFrame, embedder: Embedder = hashed_words, dimensions: int = 64) -> DataFrame:
    """Chunks that aren't discarded in the store's columns, with unit-length embeddings of text and summary."""
    @F.pandas_udf("array<double>")
    def embed(body: pd.Series) -> pd.Series:
        def unit(t: str) -> list[float]:
            v = np.asarray(embedder(t, dimensions), dtype=np.float64)
            length = float(np.linalg.norm(v))
            return (v / length if length else v).tolist()

        return body.map(unit)

    has = "validation" in chunks.columns
    return chunks.filter("disposition <> 'discarded'").select(
        "chunk_id", "page_num", "source_file", "structured_text", "intuition_summary", "key_concepts", "confidence", "agent_notes",
        (F.col("validation.verdict_score") if has else F.lit(None).cast("double")).alias("validation_score"),
        (text.join_issues(F.col("validation.issues")) if has else F.lit(None).cast("string")).alias("validation_issues"),
        embed(text.embed_text(F.col("structured_text"), F.col("intuition_summary"))).alias("embedding"),
        "chunk_type",
    )
