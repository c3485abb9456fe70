"""Events of duplicates kept up to date batch by batch, on stored tables.

A store is three tables, each a log by batch: observations, members (observation and component) and
events (what is known of a component, mergeable). A batch compares its rows with the stored ones that can
be their duplicates, maps the ends of the new edges to the stored components, and contracts only these:
members are written again only for components that are absorbed, events only for those that are touched.
The latest row of a key counts. A batch's part is replaced as a whole and counts once it is marked as
done, so that a batch that failed or comes again leaves the same store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.operators import demand
from sightline.operators.graph import FEW, components
from sightline.sources.staging import stage, unstage

OBSERVATION = "obs_id string, family_id string, connection_id string, external_id string, url_key string, platform string, tokens array<string>, published timestamp, collected timestamp, source_class string, geography string, baseline boolean"
MEMBER = "obs_id string, root string"
EVENT = (
    "family_id string, root string, anchor struct<collected: timestamp, obs_id: string>, raw_count long, source_classes array<string>, connections array<string>, geographies array<string>, "
    "first_observed timestamp, last_observed timestamp, baseline_only boolean, promotable boolean, gone boolean"
)
_BUCKET = demand.CROSS_HOURS * 3600


class EventStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _done(self) -> list[int]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/done")
        return sorted(int(x.getPath().getName()) for x in self._fs.listStatus(folder)) if self._fs.exists(folder) else []

    def _log(self, table: str, schema: str, before: int | None = None) -> DataFrame:
        """All rows of the batches that are done, with their batch."""
        done = [k for k in self._done() if before is None or k < before]
        if not done:
            return self.spark.createDataFrame([], f"{schema}, batch long")
        reader = self.spark.read.schema(f"{schema}, batch long").option("basePath", f"{self.path}/{table}")
        return reader.parquet(*(f"{self.path}/{table}/batch={k}" for k in done))

    def _latest(self, table: str, schema: str, key: str, before: int | None = None, only: DataFrame | None = None) -> DataFrame:
        rows = self._log(table, schema, before)
        rows = rows if only is None else rows.join(only.hint("merge"), key, "left_semi")
        last = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), "batch").alias("r"))
        return last.select("r.*").drop("batch")

    def members(self) -> DataFrame:
        """(obs_id, root) of every stored observation."""
        return self._latest("members", MEMBER, "obs_id")

    def events(self) -> DataFrame:
        """The events of all batches that are done, as of ``demand.evidence_events``."""
        return demand.finished_events(self._latest("events", EVENT, "root").where("NOT gone").drop("gone"))

    def apply(self, batch: int, obs: DataFrame) -> dict[str, int]:
        """Add a batch's observations; rows of known ids are left out. Returns the numbers of rows written, by table.

        Batches are numbered upwards; one that is done already is skipped.
        """
        if batch in self._done():
            return {}
        names = [f.split()[0] for f in OBSERVATION.split(", ")]
        fresh = obs.select(*names).dropDuplicates(["obs_id"]).join(self._log("observations", OBSERVATION, batch).select("obs_id").hint("merge"), "obs_id", "left_anti")
        self._write("observations", batch, fresh)
        fresh = self.spark.read.schema(OBSERVATION).parquet(f"{self.path}/observations/batch={batch}")

        known = self._candidates(self._log("observations", OBSERVATION, batch).drop("batch"), fresh)
        both = fresh.withColumn("fresh", F.lit(True)).unionByName(known.withColumn("fresh", F.lit(False)))
        edges = stage(demand.duplicate_edges(both).select("a", "b"), "fresh-edges")
        ends = edges.select(F.explode(F.array("a", "b")).alias("obs_id")).distinct()
        roots = stage(ends.join(self._latest("members", MEMBER, "obs_id", batch, ends).hint("merge"), "obs_id", "left").select("obs_id", F.coalesce("root", "obs_id").alias("root")), "fresh-roots")
        named = lambda c: roots.select(F.col("obs_id").alias(c), F.col("root").alias(f"root_{c}"))
        joined = components(edges.join(named("a").hint("merge"), "a").join(named("b").hint("merge"), "b"), "root_a", "root_b", few=FEW)
        moved = stage(joined.select(F.col("node").alias("root"), F.col("root").alias("to")), "fresh-components")

        # Members of absorbed components, and the batch's own.
        absorbed = moved.where("root <> to")
        members = self._latest("members", MEMBER, "obs_id", batch, None if absorbed.isEmpty() else self._log("members", MEMBER, batch).join(absorbed.hint("merge"), "root", "left_semi").select("obs_id").distinct())
        again = members.join(absorbed.hint("merge"), "root").select("obs_id", F.col("to").alias("root"))
        own = fresh.select("obs_id", F.col("obs_id").alias("root")).join(moved.hint("merge"), "root", "left").select("obs_id", F.coalesce("to", "root").alias("root"))
        self._write("members", batch, own.unionByName(again))

        old = self._latest("events", EVENT, "root", batch, moved.select("root")).where("NOT gone").drop("gone")
        keyed = fresh.join(own.withColumnRenamed("obs_id", "id").hint("merge"), F.col("obs_id") == F.col("id"))
        parts = demand.event_parts(keyed).unionByName(old.join(moved.hint("merge"), "root").withColumn("root", F.col("to")).drop("to"))
        merged = demand.merged_parts(parts).withColumn("gone", F.lit(False))
        gone = old.join(absorbed.hint("merge"), "root", "left_semi").withColumn("gone", F.lit(True))
        self._write("events", batch, merged.unionByName(gone))
        written = {t: self.spark.read.schema(s).parquet(f"{self.path}/{t}/batch={batch}").count() for t, s in (("observations", OBSERVATION), ("members", MEMBER), ("events", EVENT))}
        self._fs.mkdirs(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/done/{batch}"))
        for table in (edges, roots, moved):
            unstage(table)
        return written

    def _write(self, table: str, batch: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{table}/batch={batch}")

    def _candidates(self, stored: DataFrame, fresh: DataFrame) -> DataFrame:
        """Stored rows that can be duplicates of fresh ones: of an equal record or url, or of their family and within the wider window."""
        bucket = F.floor(F.unix_seconds("published") / _BUCKET)
        times = fresh.where("published IS NOT NULL").select("family_id", F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("_bucket")).distinct()
        near = stored.withColumn("_bucket", bucket).join(times.hint("merge"), ["family_id", "_bucket"], "left_semi").drop("_bucket")
        record = stored.join(fresh.select("family_id", "connection_id", "external_id").distinct().hint("merge"), ["family_id", "connection_id", "external_id"], "left_semi")
        url = stored.join(fresh.select("family_id", "url_key").where("url_key IS NOT NULL").distinct().hint("merge"), ["family_id", "url_key"], "left_semi")
        columns = stored.columns
        return near.select(columns).unionByName(record.select(columns)).unionByName(url.select(columns)).dropDuplicates(["obs_id"])
