"""SimHash near-duplicates: pivot distance tables in front of exact Hamming distances.

A text's fingerprint has bit i set if more than half of the XXH64 values (seed 42) of its three-word shingles, repeats
included, have it set. Fingerprints link at ``bits`` (3) or fewer differing bits.

Every distinct fingerprint gets a row of Hamming distances to ``PIVOTS`` fixed reference fingerprints. By the triangle
inequality the rows of two linked fingerprints differ by at most ``bits`` in every coordinate: a pair whose maximum
coordinate difference is larger is discarded inside the join, before it is a row, and only survivors are compared bit by
bit. Which pairs meet at all:

1. 64 bits are cut into B blocks; fingerprints with at most ``bits`` differing ones agree on at least B - ``bits``
   blocks, so rows are keyed by each choice of that many (10 for B = 5; B grows with the number of fingerprints);
2. in a bucket everything is compared with the hub, the fingerprint with most documents, and in buckets of at most ``SMALL``
   everything with everything; the links are joined into components;
3. fingerprints of larger buckets that still span components are keyed once more, each once and not once a bucket, by the
   same rule with ``FINER`` more blocks (56 keys of 40 bits for B = 5), and members outside a bucket's largest component
   are compared with those of other components. Pairs inside one component need no comparison, and a link between two
   components can only be in a larger bucket, so none is missed.

Documents of one fingerprint are one vertex from the start, so copies are never compared. Hot buckets, fingerprints and
components are dealt over several tasks (``spread_join``).

Nulls: a null, empty or wordless text has fingerprint zero, which links like any other. A row with a null doc_id takes part
like any other, but its component is named by the smallest doc_id that is not null (null if there is none). Repeated
rows are kept. Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.neardup import components
from quarry.llm.shared import among, cut, hot_keys, hot_limit, spread_join

N_WORDS, SEED, BITS = 3, 42, 3
PIVOTS, SMALL, FINER = 16, 8, 3
BLOCK_BYTES = 1 << 20
SPACE = re.compile(rb"[\x09-\x0d\x20]")
#: Reference fingerprints: pseudo-random, the same everywhere.
REFERENCES = [xxhash.xxh64_intdigest(b"reference %d" % i) - (1 << 63) for i in range(PIVOTS)]


def word_blocks(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text in blocks of about ``BLOCK_BYTES``, each after the last ``N_WORDS - 1`` words of the one before."""
    at, held = 0, []
    while at < len(data):
        m = SPACE.search(data, at + BLOCK_BYTES)
        end = m.start() if m else len(data)
        found = held + data[at:end].split()
        if len(found) >= N_WORDS:
            yield found
            held = found[-(N_WORDS - 1) :]
        else:
            held = found
        at = end + 1


def bit_counts(found: list[bytes], n: int) -> np.ndarray:
    """How many of the ``n``-word shingles' hashes have each bit set, highest bit first."""
    joined = b" ".join(found)
    starts = np.cumsum([0, *(len(w) + 1 for w in found)])
    spans = zip(starts[: len(found) - n + 1].tolist(), (starts[n:] - 1).tolist(), strict=True)
    digest, seed = xxhash.xxh64_digest, SEED
    hashes = np.frombuffer(b"".join([digest(joined[a:b], seed) for a, b in spans]), np.uint8).reshape(-1, 8)
    return sum(np.unpackbits(hashes[at : at + 65536], axis=1).sum(axis=0, dtype=np.int64) for at in range(0, len(hashes), 65536))


def fingerprint(text: str | None) -> int:
    """The fingerprint as a signed 64-bit number."""
    data = text.encode("utf-8", "surrogatepass").lower() if text else b""
    counts, n = np.zeros(64, np.int64), 0
    for found in word_blocks(data):
        counts += bit_counts(found, N_WORDS)
        n += len(found) - N_WORDS + 1
    if not n:
        found = data.split()
        if not found:
            return 0
        counts, n = bit_counts(found, len(found)), 1
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp of every row."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t) for t in texts], dtype="int64")

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.pandas_udf(run, "long")(F.col("text").cast("string")).alias("fp"))


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def choices(places: list[int], blocks: int, bits: int) -> list[int]:
    """Masks of every choice of ``blocks - bits`` blocks of the bit places."""
    parts = np.array_split(np.array(places), blocks)
    return [sum(1 << int(i) for k in own for i in parts[k]) for own in combinations(range(blocks), blocks - bits)]


def block_count(n: int, bits: int = BITS) -> int:
    """Blocks so that a key has at least as many values as there are fingerprints."""
    b = bits + 2
    while b < 16 and n > 2 ** (64 * (b - bits) / b):
        b += 1
    return b


def distances(fp: str) -> Column:
    """A row of the pivot table: the distances to the references."""
    return F.array(*[F.bit_count(F.col(fp).bitwiseXOR(F.lit(r))).cast("tinyint") for r in REFERENCES])


def pivot_table(fps: DataFrame) -> DataFrame:
    """``fps(fp, ...)`` with ``near``, the row of distances of each fingerprint."""
    return fps.withColumn("near", distances("fp"))


def keyed(rows: DataFrame, masks: list[tuple[int, int]]) -> DataFrame:
    """Rows once for every (number, mask): ``mask_no`` and ``key``, the fingerprint under the mask."""
    keys = F.array(*[F.struct(F.lit(no).alias("mask_no"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for no, m in masks])
    return rows.withColumn("_k", F.explode(keys)).select(*rows.columns, "_k.*")


def linked(a: str, near_a: str, b: str, near_b: str, bits: int) -> Column:
    """Survives the pivot table, then the exact distance."""
    widest = F.array_max(F.zip_with(near_a, near_b, lambda x, y: F.abs(x - y)))
    return F.when(widest <= bits, F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= bits).otherwise(F.lit(False))


def edge(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


BUCKET = ["mask_no", "key"]


def links(nodes: DataFrame, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """(edges, components) over ``nodes(fp, rows, near)``: enough edges to connect all that links, (id, comp) of their ends."""
    n = nodes.count()
    everywhere = list(range(64))
    masks = list(enumerate(choices(everywhere, block_count(n, bits), bits)))
    limit = hot_limit(len(masks) * n)
    copies = F.ceil(F.col("m") / limit).cast("int").alias("_copies")
    rows = keyed(nodes, masks)
    sized = rows.groupBy(*BUCKET).agg(F.count(F.lit(1)).alias("m"), F.max_by("fp", "rows").alias("hub"))
    buckets = cut(sized.filter("m > 1").withColumn("hub_near", distances("hub")), "buckets")
    hot = buckets.filter(F.col("m") > limit).select(*BUCKET, copies)
    met = cut(spread_join(among(rows.drop("rows"), buckets.select(*BUCKET), BUCKET), buckets, BUCKET, hot), "members")
    star = met.filter("fp <> hub").filter(linked("fp", "near", "hub", "hub_near", bits)).select(*edge("fp", "hub"))
    few = met.filter(F.col("m").between(3, SMALL)).select(*BUCKET, "fp", "near")
    other = few.select(*BUCKET, F.col("fp").alias("fp2"), F.col("near").alias("near2"))
    close = few.join(other, [few[c] == other[c] for c in BUCKET] + [F.col("fp") < F.col("fp2"), linked("fp", "near", "fp2", "near2", bits)]).select(*edge("fp", "fp2"))
    edges = cut(star.union(close).distinct(), "links")
    label = components(edges)

    # Fingerprints of larger buckets that still span components, each keyed once more by more bits.
    large = cut(met.filter(F.col("m") > SMALL).select(*BUCKET, "fp").join(label.withColumnRenamed("id", "fp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp")), "large")
    spans = lambda df: df.groupBy(*BUCKET).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select(*BUCKET)
    unsettled = cut(pivot_table(spread_join(large, spans(large), BUCKET, hot).select("fp", "comp").distinct()), "unsettled")
    left = unsettled.count()
    if not left:
        return edges, label
    masks = list(enumerate(choices(everywhere, block_count(n, bits) + FINER, bits)))
    limit = hot_limit(len(masks) * left)
    fine = cut(keyed(unsettled, masks), "finer-keys")  # read three times, made once
    fine = cut(spread_join(fine, spans(fine), BUCKET, hot_keys(fine, BUCKET, limit)), "finer")
    hot = cut(hot_keys(fine, BUCKET, limit), "hot-buckets")
    main = fine.groupBy(*BUCKET, "comp").count().groupBy(*BUCKET).agg(F.max(F.struct("count", "comp"))["comp"].alias("main"))
    minor = spread_join(fine, main, BUCKET, hot).filter("comp <> main").select(*BUCKET, F.col("fp").alias("fp2"), F.col("near").alias("near2"), F.col("comp").alias("comp2"))
    dealt = fine.join(F.broadcast(hot), BUCKET, "left").withColumn("_salt", F.pmod(F.xxhash64("fp"), F.coalesce("_copies", F.lit(1))).cast("int")).drop("_copies")
    sent = minor.join(F.broadcast(hot), BUCKET, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1))).drop("_copies")
    on = [dealt[c] == sent[c] for c in [*BUCKET, "_salt"]] + [F.col("comp") != F.col("comp2"), linked("fp", "near", "fp2", "near2", bits)]
    more = cut(dealt.join(sent, on).select(*edge("fp", "fp2")).distinct(), "further-links")
    if more.isEmpty():
        return edges, label
    edges = edges.union(more)
    return edges, components(edges)


def near_duplicates(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, fingerprint (hex), component_id, class_id (smallest doc_id of the
    fingerprint)."""
    rows = cut(fingerprints(docs), "fingerprints")
    nodes = cut(pivot_table(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("least"))), "pivot-table")
    _, label = links(nodes.select("fp", "rows", "near"), bits)
    limit = hot_limit(rows.count())
    copies = lambda n: F.ceil(F.col(n) / limit).cast("int").alias("_copies")
    named = cut(nodes.select("fp", "rows", "least").join(label.withColumnRenamed("id", "fp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp")), "named")
    first = named.groupBy("comp").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("m"))
    named = spread_join(named, first.select("comp", "component_id"), ["comp"], first.filter(F.col("m") > limit).select("comp", copies("m")))
    hot = nodes.filter(F.col("rows") > limit).select("fp", copies("rows"))
    out = spread_join(rows, named.select("fp", "component_id", F.col("least").alias("class_id")), ["fp"], hot)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "class_id")
