"""Exactly one of each message delivered at least once, by seen-bitmaps.

An identifier is a text (its namespace) and a number. A dictionary encodes texts exactly; a number is
a bit in the bitmap of its shard, (text id, number / 32768). An increment takes the rows that arrived
since the last one, picks one arrival for each of their bits and keeps it if the store has not set that
bit before; the new bits are then united into the store.

A version of the store is a marker file in ``log`` that names a folder. The folder holds what the
increment added, written before the marker: bitmaps of the touched shards and new texts only, with the
ids of the arrivals that set the bits, and the kept and dropped rows themselves. The marker is made under a name that must not exist, so of two
writers one fails and leaves nothing behind, and an increment that dies before it leaves the store as
it was; one that is named and was committed is not applied again. So bits and rows become
visible together or not at all. Every COMPACT versions all bitmaps are united in one folder.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Shards of the dictionary: ids are given out in parallel, as local number * ID_SHARDS + shard.
ID_SHARDS = 64
#: A text's rows meet its id in so many places, by their number.
SALTS = 16
COMPACT = 8


class Conflict(RuntimeError):
    """Another writer has committed the version."""


class SeenBitmaps:
    """The store at ``path``, a folder all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._Path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(self._conf)

    # versions ----------------------------------------------------------------------------------

    def version(self) -> int:
        """The committed version, 0 for an empty store."""
        log = self._Path(f"{self.path}/log")
        if not self._fs.exists(log):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(log)]
        return max([0, *(int(n) for n in names if n.isdigit())])

    def _marker(self, version: int) -> dict:
        """``name`` of the increment, its ``folder``, and the ``folders`` that hold the bits up to it."""
        if not version:
            return {"folders": []}
        stream = self._fs.open(self._Path(f"{self.path}/log/{version}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _markers(self) -> list[dict]:
        return [self._marker(v) for v in range(1, self.version() + 1)]

    def _commit(self, version: int, marker: dict) -> None:
        aside, final = f"{self.path}/aside/{uuid.uuid4().hex}", f"{self.path}/log/{version}"
        out = self._fs.create(self._Path(aside), False)
        out.write(bytearray(json.dumps(marker).encode()))
        out.close()
        self._fs.mkdirs(self._Path(f"{self.path}/log"))
        try:
            if self._fs.getUri().getScheme() == "file":  # a link is made only where no file is
                plain = lambda p: self._Path(p).toUri().getPath()
                self._link(plain(aside), plain(final))
                self._fs.delete(self._Path(aside), False)
            else:
                Rename = self._jvm.org.apache.hadoop.fs.Options.Rename
                options = self.spark.sparkContext._gateway.new_array(Rename, 1)
                options[0] = Rename.NONE
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(self._Path(aside), self._Path(final), options)
        except Exception as e:
            if isinstance(e, FileExistsError) or "FileAlreadyExists" in str(e):
                self._fs.delete(self._Path(f"{self.path}/{marker['folder']}"), True)
                raise Conflict(f"version {version} of {self.path} was committed by another increment") from e
            raise

    @staticmethod
    def _link(aside: str, final: str) -> None:
        try:
            os.link(aside, final)
        except FileExistsError:
            raise
        except OSError:  # a folder that knows no links: the name is still made only once
            with open(aside, "rb") as f, open(final, "xb") as out:
                out.write(f.read())

    # what a version holds ----------------------------------------------------------------------

    def _read(self, folders: Sequence[str], table: str) -> DataFrame | None:
        return self.spark.read.parquet(*[f"{self.path}/{f}/{table}" for f in folders]) if folders else None

    def _bits(self, folders: Sequence[str]) -> DataFrame | None:
        rows = self._read(folders, "shards")
        return rows if rows is None else rows.select("space_id", "bucket", "bits") if len(folders) == 1 else rows.groupBy("space_id", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))

    def dictionary(self) -> DataFrame | None:
        """``space`` string, ``space_id`` bigint."""
        return self._read(self._marker(self.version())["folders"], "dictionary")

    def shards(self) -> DataFrame | None:
        """``space``, ``bucket`` bigint, ``bits`` binary."""
        folders = self._marker(self.version())["folders"]
        bits = self._bits(folders)
        return None if bits is None else bits.join(self._read(folders, "dictionary"), "space_id").select("space", "bucket", "bits")

    def counts(self) -> DataFrame:
        """``space``, ``n_seen``: the bits set per text."""
        s = self.shards()
        if s is None:
            return self.spark.createDataFrame([], "space string, n_seen long")
        return s.groupBy("space").agg(F.sum(F.bitmap_count("bits")).alias("n_seen"))

    def _rows(self, versions: Sequence[int] | None, kept: bool) -> DataFrame | None:
        of = range(1, self.version() + 1) if versions is None else versions
        rows = self._read([self._marker(v)["folder"] for v in of], "rows")
        return None if rows is None else rows.where(F.col("__kept") == F.lit(kept)).drop("__kept")

    def kept(self, versions: Sequence[int] | None = None) -> DataFrame | None:
        """The rows that all increments, or those of ``versions``, kept: one per identifier and every
        row without one. None for an empty store."""
        return self._rows(versions, True)

    def dropped(self, versions: Sequence[int] | None = None) -> DataFrame | None:
        return self._rows(versions, False)

    # an increment ------------------------------------------------------------------------------

    def increment(self, df: DataFrame, space: Column, number: str, order: Sequence[str], row_id: str, name: str | None = None) -> int:
        """Split ``df`` into kept and dropped rows, unite the new bits into the store, commit all of it
        as one version and return that. A ``name`` that was committed before returns its version and
        changes nothing, so an increment of unknown fate can be run again.

        The identifier is (``space``, ``number``); rows with a null in either are kept. Of the rows of an
        identifier whose bit is not set, the one smallest by ``order`` (nulls last), then ``row_id``, is
        kept; ``row_id`` must be unique and not null. An empty ``df`` commits an empty version. Copies are
        reduced to one candidate on the map side before they meet bitmaps, so a group of copies of any
        size, or a text with most of the rows, never meets in one task; the rows are then matched by
        ``row_id``, which is not skewed. Raises Conflict if another writer was first."""
        markers = self._markers() if name is not None else []
        for v, m in enumerate(markers, 1):
            if m["name"] == name:
                return v
        v = self.version()
        folders = self._marker(v)["folders"]
        mine = f"data/{v + 1}-{uuid.uuid4().hex[:12]}"
        write = lambda t, table: t.write.parquet(f"{self.path}/{mine}/{table}")
        read = lambda table: self.spark.read.parquet(f"{self.path}/{mine}/{table}")
        compact = len(folders) + 1 >= COMPACT

        rank = F.struct(*[x for o in order for x in (F.col(o).isNull().alias(f"n_{o}"), F.col(o))], F.col(row_id).alias("__rid"))
        keyed = df.select(space.alias("__space"), F.col(number).cast("long").alias("__no"), rank.alias("__rank")).where("__space IS NOT NULL AND __no IS NOT NULL")
        known = self._read(folders, "dictionary")
        fresh = self._fresh(keyed.select(F.col("__space").alias("space")).distinct(), known)
        write(fresh if not compact or known is None else fresh.unionByName(known), "dictionary")
        coded = read("dictionary") if compact or known is None else read("dictionary").unionByName(known)
        coded = coded.select("space_id", F.col("space").alias("__s"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))

        bits = keyed.join(coded, (F.col("__space") == F.col("__s")) & (F.pmod("__no", F.lit(SALTS)) == F.col("__salt")))
        arrivals = bits.groupBy("space_id", F.bitmap_bucket_number("__no").alias("bucket"), F.bitmap_bit_position("__no").alias("bit")).agg(F.min("__rank").alias("w")).select("space_id", "bucket", "bit", F.col("w.__rid").alias("__winner"))
        old = self._bits(folders)
        if old is not None:
            byte = F.conv(F.hex(F.substring(F.col("bits"), (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            met = arrivals.join(old, ["space_id", "bucket"], "left").withColumn("__byte", byte)
            arrivals = met.where("bits IS NULL OR (shiftright(__byte, cast(bit % 8 AS int)) & 1) = 0").drop("bits", "__byte")
        # a shard's arrivals are as many as its bits at most
        new = arrivals.groupBy("space_id", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"), F.collect_list("__winner").alias("arrivals"))
        if compact and old is not None:
            new = new.unionByName(old, allowMissingColumns=True).groupBy("space_id", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"), F.first("arrivals", True).alias("arrivals"))
        write(new, "shards")
        winners = read("shards").select(F.explode("arrivals").alias("__winner"))
        flagged = df.join(winners, F.col(row_id) == F.col("__winner"), "left")
        is_kept = F.col("__winner").isNotNull() | space.isNull() | F.col(number).isNull()
        write(flagged.withColumn("__kept", is_kept).drop("__winner"), "rows")
        self._commit(v + 1, {"name": name, "folder": mine, "folders": [mine] if compact or not folders else [*folders, mine]})
        return v + 1

    def _fresh(self, spaces: DataFrame, known: DataFrame | None) -> DataFrame:
        """Ids for the texts that have none yet."""
        shard = F.pmod(F.xxhash64("space"), F.lit(ID_SHARDS))
        spaces = spaces if known is None else spaces.join(known, "space", "left_anti")
        fresh = spaces.withColumn("shard", shard).withColumn("n", F.row_number().over(Window.partitionBy("shard").orderBy("space")) - 1)
        if known is not None:
            base = known.groupBy((F.col("space_id") % ID_SHARDS).alias("shard")).agg((F.max(F.expr(f"space_id div {ID_SHARDS}")) + 1).alias("base"))
            fresh = fresh.join(base, "shard", "left").withColumn("n", F.col("n") + F.coalesce("base", F.lit(0)))
        return fresh.select("space", (F.col("n") * ID_SHARDS + F.col("shard")).cast("long").alias("space_id"))


def increments(store: SeenBitmaps, df: DataFrame, periods: Sequence[Column], space: Column, number: str, order: Sequence[str], row_id: str) -> list[int]:
    """One increment after the other, of the rows for which each of ``periods`` is true. For the same
    rows to be kept as in one go, periods must follow each other in the first of ``order``."""
    return [store.increment(df.where(p), space, number, order, row_id, name=f"period {i}") for i, p in enumerate(periods)]
