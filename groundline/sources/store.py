"""The graph's tables on disk: each is a list of parts, and one small file names the parts of all tables, so readers see all of a batch or
none of it, and a failed batch leaves what was there. What is added is a part of its own; parts are merged by sixteens, so an ingest
of any number of minibatches writes each row a few times."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundline.operators import graph

SCHEMAS = {
    "entities": "normalized_name string, name string",
    "edges": "src_norm string, dst_norm string, predicate string, chunk_text string, source_file string, chunk_index int, predicate_embedding array<float>",
    "documents": "name string, ingested_at timestamp, num_chunks long, num_triples long, status string",
    "vectors": "id string, document string, embedding array<float>, source string, chunk_index int",
}
#: Parts of one size that are merged to one of the next.
FAN = 16
#: Manifests that are kept; with older ones go the parts that only they name.
KEPT = 4


class GraphStore:
    """Entities, edges, documents and vectors under one folder of any file system that Spark can write.

    One writer at a time: of two that commit the same version, the second fails and must read again. A table that a reader holds stays
    readable for ``KEPT`` more commits.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        manifests = self._fs.globStatus(self._fs_path(f"{self.path}/manifest-*.json")) or []
        return sorted(int(m.getPath().getName()[9:-5]) for m in manifests)

    def _manifest(self, number: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/manifest-{number:08d}.json", wholetext=True).first()[0])

    def _current(self) -> tuple[int, dict]:
        """The last version's number and manifest: ``tables``, the parts ``[path, size class]`` of each, and ``epochs``."""
        numbers = self._numbers()
        return (numbers[-1], self._manifest(numbers[-1])) if numbers else (0, {"tables": {}, "epochs": {}})

    def _read(self, name: str, parts: list) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(*(p for p, _ in parts)) if parts else self.spark.createDataFrame([], SCHEMAS[name])

    def table(self, name: str) -> DataFrame:
        return self._read(name, self._current()[1]["tables"].get(name, []))

    def seen(self, stream: str) -> int:
        """The last epoch of a stream that was committed; -1 for none."""
        return self._current()[1]["epochs"].get(stream, -1)

    def commit(self, replace: dict[str, DataFrame] | None = None, append: dict[str, DataFrame] | None = None, epoch: tuple[str, int] | None = None) -> None:
        """Puts tables in the place of old ones, and adds rows to others, together. ``epoch`` of a stream is noted with them."""
        number, manifest = self._current()
        for name, df in (replace or {}).items():
            manifest["tables"][name] = [[self._write(name, number + 1, df), 0]]
        for name, df in (append or {}).items():
            parts = [*manifest["tables"].get(name, []), [self._write(name, number + 1, df), 0]]
            size = 0
            while len(same := [p for p in parts if p[1] == size]) >= FAN:
                merged = self._write(name, number + 1, self._read(name, same).coalesce(max(1, FAN**size)))
                parts = [p for p in parts if p[1] != size] + [[merged, size + 1]]
                size += 1
            manifest["tables"][name] = parts
        if epoch:
            manifest["epochs"][epoch[0]] = epoch[1]
        stream = self._fs.create(self._fs_path(f"{self.path}/manifest-{number + 1:08d}.json"), False)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        self._forget()

    def _write(self, name: str, number: int, df: DataFrame) -> str:
        path = f"{self.path}/{name}-{number:08d}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def _forget(self) -> None:
        numbers = self._numbers()
        old, kept = numbers[:-KEPT], numbers[-KEPT:]
        if old:
            named = {p for n in kept for parts in self._manifest(n)["tables"].values() for p, _ in parts}
            for n in old:
                for path in {p for parts in self._manifest(n)["tables"].values() for p, _ in parts} - named:
                    self._fs.delete(self._fs_path(path), True)
                self._fs.delete(self._fs_path(f"{self.path}/manifest-{n:08d}.json"), False)

    def clear(self) -> None:
        """Empties the graph: entities, edges and documents."""
        self.commit(replace={n: self.spark.createDataFrame([], SCHEMAS[n]) for n in ("entities", "edges", "documents")})

    def write_triples(self, triples: DataFrame, replace: bool = False, documents: DataFrame | None = None, epoch: tuple[str, int] | None = None) -> int:
        """Adds a batch of triples and the entities they name that are new; the number of triples. With ``replace``, sources that come again
        lose their old edges. ``documents``, the catalog as it then is, and ``epoch`` are committed with them."""
        order = [F.col(c) for c in ("source_file", "chunk_index", "predicate", "subject", "obj")]
        fresh = graph.edges_of(triples)
        named = graph.mentions(triples, order).join(self.table("entities"), "normalized_name", "left_anti").select("normalized_name", "name")
        whole = {} if documents is None else {"documents": documents}
        if replace:
            self.commit(whole | {"edges": graph.replace_source(self.table("edges"), fresh)}, {"entities": named}, epoch)
        else:
            self.commit(whole, {"entities": named, "edges": fresh}, epoch)
        return triples.count()

    def is_connected(self) -> bool:
        """Whether the folder's file system answers."""
        try:
            self._fs.getStatus()
            return True
        except Exception:  # a probe tells, it doesn't raise
            return False

    def info(self) -> dict[str, object]:
        """Where the store is and its version, and how many parts each table has."""
        number, manifest = self._current()
        return {"uri": str(self._fs.getUri()), "path": self.path, "version": number, "parts": {n: len(p) for n, p in manifest["tables"].items()}}

    def stats(self) -> dict[str, int]:
        """Numbers of entities and edges."""
        return graph.stats(self.table("entities"), self.table("edges")).first().asDict()

    def write_document(self, name: str, num_chunks: int, num_triples: int, status: str) -> None:
        """Sets a document's row; nothing for an empty name."""
        if name:
            row = self.spark.createDataFrame([(name, num_chunks, num_triples, status)], "name string, num_chunks long, num_triples long, status string")
            fresh = row.select("name", F.current_timestamp().alias("ingested_at"), "num_chunks", "num_triples", "status")
            self.commit({"documents": graph.upsert_documents(self.table("documents"), fresh)})

    def ingest(self, triples: DataFrame, name: str, num_chunks: int) -> int:
        """Writes a document's triples and marks it done; if that fails, marks it an error and raises."""
        try:
            n = self.write_triples(triples)
        except Exception:
            self.write_document(name, num_chunks, 0, "error")
            raise
        self.write_document(name, num_chunks, n, "done")
        return n

    def write_vectors(self, fresh: DataFrame, rebuild: bool = False) -> DataFrame:
        """Puts vectors in by id, the last of equal ids; counts of rows given and of ids held."""
        old = self.spark.createDataFrame([], SCHEMAS["vectors"]) if rebuild else self.table("vectors")
        n = fresh.count()
        self.commit({"vectors": graph.upsert_vectors(old, fresh.withColumn("_at", F.monotonically_increasing_id()), ["_at"])})
        return self.table("vectors").agg(F.lit(n).alias("given"), F.count(F.lit(1)).alias("held"))

    def is_ready(self) -> bool:
        return not self.table("vectors").isEmpty()

    def ensure_vectors(self, build) -> None:
        """Builds the collection with ``build()`` where it is empty."""
        if not self.is_ready():
            self.write_vectors(build())

    def reset_vectors(self) -> None:
        self.commit({"vectors": self.spark.createDataFrame([], SCHEMAS["vectors"])})
