"""A durable cursor over a table of images, which several readers share: shift takes the first ones, pop the last, each image once.

Opening a cursor numbers the images in the order of their paths (or ids) and writes them once; after that its folder holds one
small file for each claim. A claim is a range of places, and making its file is the one step that only one reader can win: the
losers look again and claim what follows. A reader that commits a claim has done with its images; one that fails releases it, or
lets its lease run out, and then the images are the next to be handed out again. Nothing is ever rewritten, so a reader that dies
at any moment leaves a state that the others can go on from.

Times are those of the readers' clocks. Listing the folder takes time with the number of claims, so claim many images at once.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Claim:
    """The places start to stop - 1, handed out as number `number` for the `attempt`-th time, until `until`."""

    number: int
    attempt: int
    start: int
    stop: int
    until: float


class ImageCursor:
    """`folder` is one that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, lease: float = 600.0):
        self.spark, self.folder, self.lease = spark, folder.rstrip("/"), lease
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self.images = spark.read.parquet(f"{self.folder}/images")
        self.size = self.images.count()

    @classmethod
    def open(cls, images: DataFrame, folder: str, lease: float = 600.0) -> ImageCursor:
        """A cursor over images (path or image_id, ...); one that the folder holds already goes on where it stood."""
        spark, folder = images.sparkSession, folder.rstrip("/")
        fs = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/images/_SUCCESS")):
            key = "path" if "path" in images.columns else "image_id"
            sorted_ = f"{folder}/sorted-{uuid.uuid4().hex}"  # ranges of keys, each of which counts its own rows
            images.repartitionByRange(key).withColumn("part", F.spark_partition_id()).write.parquet(sorted_)
            rows = spark.read.parquet(sorted_)
            before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
            starts = rows.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))  # one row for each partition
            at = F.col("start") + F.row_number().over(Window.partitionBy("part").orderBy(key)) - 1
            numbered = rows.join(F.broadcast(starts), "part").withColumn("place", at).drop("part", "start")
            numbered.write.mode("ignore").parquet(f"{folder}/images")
        return cls(spark, folder, lease)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _made(self, name: str, text: str) -> bool:
        """Whether this reader made the file; whoever comes second does not."""
        path = self._path(name)
        if self._fs.getScheme() == "file":
            local = path.toUri().getPath()
            os.makedirs(os.path.dirname(local), exist_ok=True)
            whole = f"{local}.{uuid.uuid4().hex}"
            with open(whole, "w") as out:
                out.write(text)
            try:
                os.link(whole, local)  # with its content, or not at all
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(whole)
        try:
            out = self._fs.create(path, False)
        except Exception as error:  # noqa: BLE001 - the store's own error for a file that is there
            if self._fs.exists(path):
                return False
            raise error
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def _files(self, kind: str) -> dict[tuple[int, ...], str]:
        """Names of a kind's files by their numbers."""
        if not self._fs.exists(self._path(kind)):
            return {}
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(kind))]
        return {tuple(map(int, n.split("-"))): n for n in names if all(part.isdigit() for part in n.split("-"))}

    def _read(self, name: str) -> dict:
        stream = self._fs.open(self._path(name))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def claims(self) -> dict[int, Claim]:
        """The newest attempt of every claim."""
        newest: dict[int, Claim] = {}
        for (number, attempt), name in sorted(self._files("claims").items()):
            newest[number] = Claim(number, attempt, **self._read(f"claims/{name}"))
        return newest

    def _open_again(self) -> list[Claim]:
        """Claims that were given back or whose lease is over, the first places first."""
        done, back, now = self._files("done"), self._files("released"), time.time()
        lost = [c for c in self.claims().values() if (c.number,) not in done and ((c.number, c.attempt) in back or c.until < now)]
        return sorted(lost, key=lambda c: c.start)

    def shift(self, count: int = 1, last: bool = False) -> tuple[Claim, DataFrame] | None:
        """The first `count` images that nobody has (or the last, none across a gap), fewer at the end; None when all are taken."""
        while True:
            until = time.time() + self.lease
            again = [] if last else self._open_again()
            if again:
                c = Claim(again[0].number, again[0].attempt + 1, again[0].start, again[0].stop, until)
            else:
                held = self.claims()
                front = max((c.stop for c in held.values() if c.number % 2 == 0), default=0)
                back = min((c.start for c in held.values() if c.number % 2 == 1), default=self.size)
                if front >= back:
                    return None
                start, stop = (max(front, back - count), back) if last else (front, min(front + count, back))
                # claims from the front have even numbers, from the back odd ones; a number is one end's next step
                number = max((c.number for c in held.values() if c.number % 2 == int(last)), default=int(last) - 2) + 2
                c = Claim(number, 0, start, stop, until)
            if self._made(f"claims/{c.number}-{c.attempt}", json.dumps({"start": c.start, "stop": c.stop, "until": c.until})):
                if c.attempt == 0 and any(o.number != c.number and o.start < c.stop and c.start < o.stop for o in self.claims().values()):
                    # the ends met: the reader at the back gives way, and the front's claim holds
                    if last:
                        self._made(f"done/{c.number}", "")
                        continue
                return c, self.images.where((F.col("place") >= c.start) & (F.col("place") < c.stop))

    def pop(self, count: int = 1) -> tuple[Claim, DataFrame] | None:
        return self.shift(count, last=True)

    def commit(self, claim: Claim) -> None:
        """The claim's images are done with."""
        self._made(f"done/{claim.number}", "")

    def release(self, claim: Claim) -> None:
        """The claim's images go to whoever asks next."""
        self._made(f"released/{claim.number}-{claim.attempt}", "")


def without(images: DataFrame, index: int) -> DataFrame:
    """A table of images without the one at a place in the order of paths or ids; beyond the end it stays whole."""
    key = "path" if "path" in images.columns else "image_id"
    gone = images.orderBy(key).offset(index).limit(1).select(key)
    return images.join(F.broadcast(gone), key, "left_anti")
