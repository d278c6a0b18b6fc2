"""Checks of copies against their sources."""

from __future__ import annotations

import hashlib

import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codecs as Z

#: Parity bytes a stripe of a stored chunk.
PARITY = 4


def sample_compare(source: DataFrame, dest: DataFrame, n: int) -> DataFrame:
    """Problems among the first n source files by path: missing at the destination, or of other content."""
    first = source.orderBy("path").limit(n).select("rel", "hash")
    at = dest.select("rel", F.col("hash").alias("d_hash"))
    return first.join(at, "rel", "left").where("d_hash IS NULL OR d_hash <> hash").select("rel", F.when(F.col("d_hash").isNull(), "missing").otherwise("mismatch").alias("problem"))


def restore_problems(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Chunks of a restored volume that differ: data is fatal, a hole that isn't one (or the reverse) is a warning."""
    f = found.select("idx", *(F.col(c).alias(f"f_{c}") for c in ("is_hole", "size", "digest")))
    flip = F.col("is_hole") != F.col("f_is_hole")
    data = ~F.col("is_hole") & ((F.col("size") != F.col("f_size")) | (F.col("digest") != F.col("f_digest")))
    return expected.join(f, "idx").where(flip | data).select("idx", F.when(flip, "warn").otherwise("fatal").alias("severity"))


def resume_ranges(extents: DataFrame, unit: int, verified: int) -> DataFrame:
    """What is left of each extent's bytes beyond those verified."""
    start, end = F.col("lo") * unit, (F.col("lo") + F.col("cnt")) * unit
    return extents.where((F.col("cnt") > 0) & (end > verified)).select("vol", "id", F.greatest(start, F.lit(verified).cast("long")).alias("from"), end.alias("to"))


def store_chunks(chunks: DataFrame) -> DataFrame:
    """(digest, codec, stored, ecc) of each distinct (digest, data): encoded, with parity beside it."""

    def run(batches):
        for batch in batches:
            coded = Z.encode_all(batch.column("data").to_pylist())
            stored = [raw for _, raw in coded]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array([codec for codec, _ in coded], pa.int64()), pa.array(stored, pa.binary()), pa.array(Z.parity_all(stored, PARITY), pa.binary())], ["digest", "codec", "stored", "ecc"])

    return chunks.dropDuplicates(["digest"]).select("digest", "data").mapInArrow(run, "digest string, codec long, stored binary, ecc binary")


def _states(batches):
    """What the bytes of each stored chunk are worth: ok, repaired from parity, or damaged; and their plain length."""
    unpack = zs.ZstdDecompressor()

    def length(digest, codec, raw):
        try:
            data = Z.decode(codec, raw, plain=unpack)
        except (zs.ZstdError, ValueError):
            return None
        return len(data) if hashlib.sha256(data).hexdigest() == digest else None

    for batch in batches:
        digest, codec, stored, ecc = (batch.column(c).to_pylist() for c in ("digest", "codec", "stored", "ecc"))
        plain = list(map(length, digest, codec, stored))
        state = ["ok" if n is not None else "damaged" for n in plain]
        bad = [i for i, n in enumerate(plain) if n is None]
        for i, fixed in zip(bad, Z.repair_all([stored[i] for i in bad], [ecc[i] for i in bad], PARITY), strict=True):
            if fixed is not None and (n := length(digest[i], codec[i], fixed)) is not None:
                plain[i], state[i] = n, "repaired"
        yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(state, pa.string()), pa.array(plain, pa.int64())], ["digest", "state", "plain"])


def store_problems(entries: DataFrame, store: DataFrame, holes: str = "is_hole") -> DataFrame:
    """Entries that can't be read as they say: missing, damaged beyond parity, repaired, or of another size.  Each chunk is read once; holes need none."""
    seen = store.select("digest", "codec", "stored", "ecc").mapInArrow(_states, "digest string, state string, plain long")
    problem = F.when(F.col("state").isNull(), "missing").when(F.col("state") == "damaged", "damaged").when(F.col("plain") != F.col("size"), "size").when(F.col("state") == "repaired", "repaired")
    return entries.where(~F.col(holes)).join(seen, "digest", "left").withColumn("problem", problem).where("problem IS NOT NULL")
