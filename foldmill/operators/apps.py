"""The shipped aggregates: counts, inverted index, rank contributions, similarity buckets, nearest neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldmill.functions.scalars import half, rotations
from foldmill.functions.tokens import LINES, WORDS, ngrams, records, tokens
from foldmill.plans.lineage import cut
from foldmill.plans.spec import AggSpec, register


def _ones(keys: Column) -> Column:
    return F.transform(keys, lambda k: F.struct(k.alias("key"), F.lit(1).cast("long").alias("n")))


def _total() -> Column:
    return F.sum("n")


def count_spec(n: int = 1, text: str = "text", delimiters: str = WORDS) -> AggSpec:
    """Counts of a text's n-grams of tokens."""
    return AggSpec(create=lambda: _ones(ngrams(tokens(F.col(text), delimiters), n)), merge={"n": _total})


def field_count_spec(text: str = "text", first: str = LINES, second: str = WORDS) -> AggSpec:
    """Counts of the first field of two-level records."""
    return AggSpec(create=lambda: _ones(F.transform(records(F.col(text), first, second), lambda r: F.get(r, F.lit(0)))), merge={"n": _total})


def index_spec(text: str = "text", book: str = "source", delimiters: str = WORDS) -> AggSpec:
    """Inverted index: for each token the sorted distinct books that have it. A text sends each token once."""

    def create() -> Column:
        return F.transform(F.array_distinct(tokens(F.col(text), delimiters)), lambda k: F.struct(k.alias("key"), F.col(book).cast("string").alias("book")))

    return AggSpec(create=create, merge={"books": lambda: F.array_sort(F.collect_set("book"))})


def rank_spec() -> AggSpec:
    """One step of rank contributions: a node with links gives each an equal part of its rank; there is no damping.
    ``links`` of a merged node is its first that isn't null; a step sends none, as the node itself isn't sent."""

    def divide() -> Column:
        part = F.col("rank") / F.size("links")
        none = F.lit(None).cast("array<string>")
        sent = F.transform("links", lambda k: F.struct(k.alias("key"), part.alias("rank"), none.alias("links")))
        return F.when(F.size("links") > 0, sent).otherwise(F.array().cast("array<struct<key:string,rank:double,links:array<string>>>"))

    return AggSpec(divide=divide, merge={"rank": lambda: F.sum("rank"), "links": lambda: F.first("links", ignorenulls=True)})


def bucket_spec(digest: str = "digest", name: str = "name", whole: bool = False) -> AggSpec:
    """Similarity buckets: a digest rotated by its quarters, or the first halves of that, each with the sorted names that share it."""

    def create() -> Column:
        key = (lambda r: r) if whole else half
        return F.transform(rotations(F.col(digest)), lambda r: F.struct(key(r).alias("key"), F.col(name).cast("string").alias("name")))

    return AggSpec(create=create, merge={"names": lambda: F.array_sort(F.collect_list("name"))})


def nearest(pairs: DataFrame, k: int, query: str = "query", key: str = "key", distance: str = "distance") -> DataFrame:
    """The k nearest rows of each query, ties by key. Each task keeps its k best before the shuffle."""
    place = F.row_number().over(Window.partitionBy(query).orderBy(distance, key))
    return pairs.withColumn("place", place).where(F.col("place") <= k)


def ranks(links: DataFrame, rounds: int, damping: float | None = None, cut_every: int = 10) -> DataFrame:
    """(key, rank) after some steps over (key, links), all ranks 1 at first.

    The links are joined back at each step, since a step drops them; without
    damping, nodes that nothing links to leave. With damping d, every node of
    ``links`` has 1 - d beside d times what it is sent.
    """
    spec = rank_spec()
    now = links.select("key", F.lit(1.0).alias("rank"), "links")
    out = now.select("key", "rank")
    for k in range(1, rounds + 1):
        out = spec.merged(spec.divided(now)).select("key", "rank")
        if damping is not None:
            out = links.select("key").join(out, "key", "left").select("key", (F.lit(1 - damping) + damping * F.coalesce("rank", F.lit(0.0))).alias("rank"))
        if k % cut_every == 0 and k < rounds:
            out = cut(out)
        now = out.join(links, "key", "left").select("key", "rank", "links")
    return out


register("word_count", count_spec())
register("line_count", count_spec(delimiters=LINES))
register("bigram_count", count_spec(2))
register("trigram_count", count_spec(3))
register("field_count", field_count_spec())
register("inverted_index", index_spec())
register("rank", rank_spec())
register("similarity_buckets", bucket_spec())
register("similarity_buckets_full", bucket_spec(whole=True))
