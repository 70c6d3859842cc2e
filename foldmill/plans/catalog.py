"""The queries of the engine's own operators over the driver's tables, with their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from foldmill.functions import hashing, packing, scalars, sequences, tokens
from foldmill.operators import apps, sinks
from foldmill.operators.crossing import cross_queries, spread
from foldmill.plans.job import Job
from foldmill.plans.spec import PythonAgg

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Literal query words of the crossing queries.
QUERY_WORDS = ("the", "der", "que")
PARTITIONS = 16
IMAGE_SIDE = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Register the function as a query of its name, with its SQL where there is one."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def sql_class(delimiters: str) -> str:
    return tokens.char_class(delimiters).replace("'", "''")


def sql_tokens(text: str, delimiters: str = tokens.WORDS) -> str:
    return f"list_filter(string_split_regex({text}, '{sql_class(delimiters)}'), lambda x: x <> '')"


def sql_bytes(key: str) -> str:
    """The UTF-8 bytes of a key as numbers."""
    return f"list_transform(range(1, strlen({key}) + 1), lambda i: ('0x' || substr(hex(encode({key})), 2 * i - 1, 2))::bigint)"


SQL_WORDS = f"select unnest({sql_tokens('text')}) as key from documents"
SQL_COUNTS = f"select key, count(*)::bigint as n from ({SQL_WORDS}) group by key"


def counted(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: Job(name, table(spark, sf_dir, "documents")).run(spark)


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted("word_count")(spark, sf_dir)


@query(SQL_COUNTS)
def word_count(spark, sf_dir):
    return word_counts(spark, sf_dir)


@query(f"select key, count(*)::bigint as n from (select unnest({sql_tokens('text', tokens.LINES)}) as key from documents) group by key")
def line_count(spark, sf_dir):
    return counted("line_count")(spark, sf_dir)


@query(
    f"""select key, count(*)::bigint as n from (
    select unnest(list_filter(list_transform({sql_tokens("text", tokens.LINES)}, lambda r: ({sql_tokens("r")})[1]), lambda k: k is not null)) as key from documents) group by key"""
)
def field_count(spark, sf_dir):
    return counted("field_count")(spark, sf_dir)


@query(
    f"""with t as (select {sql_tokens("text")} as t from documents)
    select key, count(*)::bigint as n from (select unnest(list_transform(range(1, len(t)), lambda i: t[i] || '-' || t[i + 1])) as key from t) group by key"""
)
def bigram_count(spark, sf_dir):
    return counted("bigram_count")(spark, sf_dir)


@query(
    f"""with t as (select {sql_tokens("text")} as t from documents)
    select key, count(*)::bigint as n from (select unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || '-' || t[i + 1] || '-' || t[i + 2])) as key from t) group by key"""
)
def trigram_count(spark, sf_dir):
    return counted("trigram_count")(spark, sf_dir)


@query(
    f"""select key, array_to_string(list_sort(list(distinct source)), ' ') as books from (
    select source, unnest({sql_tokens("text")}) as key from documents) where source is not null group by key"""
)
def inverted_index(spark, sf_dir):
    found = counted("inverted_index")(spark, sf_dir)
    return found.where(F.size("books") > 0).select("key", F.array_join("books", " ").alias("books"))


@query(
    f"""select query, source, count(*)::bigint as records, sum((key = query)::int)::bigint as hits from
    (select source, unnest({sql_tokens("text")}) as key from documents) cross join (select unnest({list(QUERY_WORDS)}) as query) group by query, source"""
)
def query_word_cross(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("source", F.explode(tokens.tokens(F.col("text"))).alias("key"))
    asked = spark.createDataFrame([(w,) for w in QUERY_WORDS], "query string")
    crossed = cross_queries(words.groupBy("source", "key").agg(F.count("*").alias("n")), asked)
    hits = F.sum(F.when(F.col("key") == F.col("query"), F.col("n")).otherwise(0))
    return crossed.groupBy("query", "source").agg(F.sum("n").alias("records"), hits.alias("hits"))


@query("select doc_id, item_id, abs(length(d.text) - length(b.text))::bigint as difference, contains(d.text, b.text) as contained from documents d cross join benchmark b")
def query_file_cross(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("contents"))
    crossed = cross_queries(spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"), items)
    difference = F.abs(F.length("text") - F.length("contents")).cast("long")
    return crossed.select("doc_id", "item_id", difference.alias("difference"), F.contains("text", "contents").alias("contained"))


def part_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's distinct suppliers as its links; both are numbers, so suppliers are nodes too."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("key"), F.col("l_suppkey").cast("string").alias("link"))
    return rows.where("key is not null and link is not null").groupBy("key").agg(F.array_sort(F.collect_set("link")).alias("links"))


SQL_LINKS = "select distinct l_partkey::varchar as key, l_suppkey::varchar as link from lineitem where l_partkey is not null and l_suppkey is not null"


def sql_ranks(rounds: int, damping: float | None = None) -> str:
    out = f"with links as ({SQL_LINKS}), nodes as (select key, count(*) as degree from links group by key), r0 as (select key, 1.0::double as rank from nodes)"
    for k in range(rounds):
        step = f"select l.link as key, sum(r.rank / n.degree) as rank from r{k} r join nodes n on r.key = n.key join links l on l.key = r.key group by l.link"
        if damping is not None:
            step = f"select n.key, {1 - damping}::double + {damping}::double * coalesce(s.rank, 0) as rank from nodes n left join ({step}) s on n.key = s.key"
        out += f", r{k + 1} as ({step})"
    return out + f" select key, round(rank, 6) as rank from r{rounds}"


@query(sql_ranks(1))
def rank_step(spark, sf_dir):
    nodes = part_links(spark, sf_dir).withColumn("rank", F.lit(1.0))
    return Job("rank", nodes, strategy="iterative").run(spark).select("key", F.round("rank", 6).alias("rank"))


@query(sql_ranks(3))
def rank_iter3(spark, sf_dir):
    return apps.ranks(part_links(spark, sf_dir), 3).select("key", F.round("rank", 6).alias("rank"))


@query(sql_ranks(3, 0.85))
def rank_damped(spark, sf_dir):
    return apps.ranks(part_links(spark, sf_dir), 3, 0.85).select("key", F.round("rank", 6).alias("rank"))


@query(
    """with m as (select vec_id, embedding::double[] as e, list_aggregate(embedding::double[], 'median') as mid from embeddings)
    select vec_id, array_to_string(list_transform(e, lambda x: case when x > mid then '1' else '0' end), '') as bits from m"""
)
def threshold_hash(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", sequences.threshold_bits(F.col("embedding")).alias("bits"))


def sql_buckets(whole: bool) -> str:
    turned = "substr(h, 1 + (i * (length(h) // 4)) % length(h)) || substr(h, 1, (i * (length(h) // 4)) % length(h))"
    key = turned if whole else f"substr({turned}, 1, length(h) // 2)"
    return f"""select key, array_to_string(list_sort(list(name)), ' ') as names from (
    select {key} as key, name from (select substr(md5(text), 1, 8) as h, doc_id::varchar as name from documents where text is not null), range(1, 5) as r(i)) group by key"""


def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select(F.substring(F.md5("text"), 1, 8).alias("digest"), F.col("doc_id").alias("name"))


@query(sql_buckets(False))
def similarity_buckets(spark, sf_dir):
    return Job("similarity_buckets", digests(spark, sf_dir)).run(spark).select("key", F.array_join("names", " ").alias("names"))


@query(sql_buckets(True))
def similarity_buckets_full(spark, sf_dir):
    return Job("similarity_buckets_full", digests(spark, sf_dir)).run(spark).select("key", F.array_join("names", " ").alias("names"))


def sql_nearest(k: int) -> str:
    return f"""with v as (select vec_id, ('0x' || substr(md5(vec_id::varchar), 1, 15))::bigint as h from embeddings),
    p as (select q.vec_id as query, v.vec_id as key, abs(q.h - v.h) as distance from v join v q on q.vec_id % 50 = 0 and q.vec_id <> v.vec_id),
    o as (select *, row_number() over (partition by query order by distance, key) as place from p)
    select query, key, distance::bigint as distance, place::int as place from o where place <= {k}"""


def hashed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with each query vector (ids divisible by 50) and the distance of their hashes."""
    h = scalars.unsigned(F.concat(F.lit("0x"), F.substring(F.md5(F.col("vec_id").cast("string")), 1, 15))).cast("long")
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), h.alias("h"))
    asked = v.where(F.col("key") % 50 == 0).select(F.col("key").alias("query"), F.col("h").alias("g"))
    return cross_queries(v, asked).where("key <> query").select("query", "key", scalars.distance(F.col("h"), F.col("g")).alias("distance"))


@query(sql_nearest(1))
def nearest_1(spark, sf_dir):
    return apps.nearest(hashed_pairs(spark, sf_dir), 1)


@query(sql_nearest(5))
def nearest_5(spark, sf_dir):
    return apps.nearest(hashed_pairs(spark, sf_dir), 5)


SQL_BYTE_SUM = f"coalesce(list_sum(list_transform({sql_bytes('key')}, lambda b: (b + 128) % 256 - 128)), 0)"


@query(f"select ((({SQL_BYTE_SUM}) % {PARTITIONS} + {PARTITIONS}) % {PARTITIONS})::int as pid, count(*)::bigint as keys, sum(n)::bigint as n from ({SQL_COUNTS}) group by 1")
def partition_histogram(spark, sf_dir):
    parts = sinks.with_partition(word_counts(spark, sf_dir), PARTITIONS)
    return parts.groupBy("pid").agg(F.count("*").alias("keys"), F.sum("n").alias("n"))


@query(f"select key, list_reduce({sql_bytes('key')}, lambda h, b: xor((h * 16777619) & 4294967295, b), 2166136261::bigint) as h from ({SQL_COUNTS})")
def fnv1_32(spark, sf_dir):
    return word_counts(spark, sf_dir).select("key", hashing.fnv1(F.col("key")).alias("h"))


@query("select doc_id, md5(text) as m, sha1(text) as s from documents")
def md5_sha1(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.lower(F.hex(hashing.md5_raw(F.col("text")))).alias("m"), F.lower(F.hex(hashing.sha1_raw(F.col("text")))).alias("s"))


MASK = 0xFFFFFFFF
#: Each key with its bytes s, their number n, and the number w of whole words of four.
SQL_KEY_BYTES = f"select key, {sql_bytes('key')} as s, strlen(key) as n, strlen(key) // 4 as w from ({SQL_COUNTS})"


def sql_word(at: str) -> str:
    """Four bytes from a place (from 0), the lowest first; bytes beyond the end count nothing."""
    return "(" + " | ".join(f"(coalesce(s[{at} + {k + 1}], 0) << {8 * k})" for k in range(4)) + ")"


def sql_left(a: str, k: int) -> str:
    return f"((({a}) << {k}) & {MASK})"


def sql_turned(a: str, k: int) -> str:
    return f"((({a} << {k}) | ({a} >> {32 - k})) & {MASK})"


def sql_rounds(inner: str, steps: list[tuple[str, str]], state: str, keep: str) -> str:
    """Nested selects, each with one column of the state replaced."""
    for name, expression in steps:
        inner = f"select {keep}, " + ", ".join(f"({expression}) & {MASK} as {c}" if c == name else c for c in state) + f" from ({inner})"
    return inner


def sql_lookup3() -> str:
    """Two mixes, for blocks of twelve bytes and for the last: (column, column that is turned and by how much, further column)."""
    mix = []
    for k, (x, y, z) in zip((4, 6, 8, 16, 19, 4), ("acb", "bac", "cba") * 2, strict=True):
        mix += [(x, f"{x} - {y} + {MASK + 1}"), (x, f"xor({x}, {sql_turned(y, k)})"), (y, f"{y} + {z}")]
    last = []
    for k, (x, y) in zip((14, 11, 25, 16, 4, 14, 24), ("cb", "ac", "ba", "cb", "ac", "ba", "cb"), strict=True):
        last += [(x, f"xor({x}, {y})"), (x, f"{x} - {sql_turned(y, k)} + {MASK + 1}")]
    added = [(c, f"{c} + {sql_word(f'12 * i + {4 * k}')}") for k, c in enumerate("abc")]
    first = f"select key, s, n, 0::bigint as i, (3735928559 + n) & {MASK} as a, (3735928559 + n) & {MASK} as b, (3735928559 + n) & {MASK} as c from ({SQL_KEY_BYTES})"
    step = sql_rounds("select * from r where n - 12 * i > 12", [*added, *mix], "abc", "key, s, n, i")
    end = sql_rounds("select * from r where n - 12 * i <= 12", [*added, *last], "abc", "key, s, n, i")
    return f"with recursive r as ({first} union all select key, s, n, i + 1 as i, a, b, c from ({step})) select key, c::bigint as h from ({end})"


def sql_murmur2(seed: int = 42, m: int = 0x5BD1E995) -> str:
    words = f"list_transform(range(0, w), lambda i: {sql_word('4 * i')})"
    mixed = f"list_transform(list_transform(list_transform({words}, lambda k: (k * {m}) & {MASK}), lambda k: xor(k, k >> 24)), lambda k: (k * {m}) & {MASK})"
    inner = f"select key, s, n, w, list_reduce({mixed}, lambda h, k: xor((h * {m}) & {MASK}, k), xor({seed}, n)::bigint) as h from ({SQL_KEY_BYTES})"
    inner = f"select key, case when n % 4 > 0 then (xor(h, {sql_word('4 * w')}) * {m}) & {MASK} else h end as h from ({inner})"
    return "select key, h::bigint as h from (" + sql_rounds(inner, [("h", "xor(h, h >> 13)"), ("h", f"h * {m}"), ("h", "xor(h, h >> 15)")], "h", "key") + ")"


def sql_superfast() -> str:
    words = f"list_transform(range(0, w), lambda i: {sql_word('4 * i')})"
    low = f"((h + (k & 65535)) & {MASK})"
    both = f"xor({sql_left(low, 16)}, xor((k >> 16) << 11, {low}))"
    inner = f"select key, s, n, w, list_reduce({words}, lambda h, k: ({both} + ({both} >> 11)) & {MASK}, n::bigint) as h from ({SQL_KEY_BYTES})"
    half, signed = "(s[4 * w + 1] | (s[4 * w + 2] << 8))", lambda k: f"((s[4 * w + {k}] + 128) % 256 - 128)"
    cases = {
        3: [f"h + {half}", f"xor(h, {sql_left('h', 16)})", f"xor(h, ({signed(3)} * 262144) & {MASK})", "h + (h >> 11)"],
        2: [f"h + {half}", f"xor(h, {sql_left('h', 11)})", "h + (h >> 17)"],
        1: [f"h + {signed(1)} + {MASK + 1}", f"xor(h, {sql_left('h', 10)})", "h + (h >> 1)"],
    }
    steps = [("h", f"case when n % 4 = {rest} then {x} else h end") for rest, tail in cases.items() for x in tail]
    steps += [("h", x) for up, down in ((3, 5), (4, 17), (25, 6)) for x in (f"xor(h, {sql_left('h', up)})", f"h + (h >> {down})")]
    return "select key, h::bigint as h from (" + sql_rounds(inner, steps, "h", "key, s, n, w") + ")"


@query(sql_lookup3())
def bob32(spark, sf_dir):
    return word_counts(spark, sf_dir).select("key", hashing.lookup3(F.col("key")).alias("h"))


@query(sql_murmur2())
def murmur2_32(spark, sf_dir):
    return word_counts(spark, sf_dir).select("key", hashing.murmur2(F.col("key")).alias("h"))


@query(sql_superfast())
def superfast32(spark, sf_dir):
    return word_counts(spark, sf_dir).select("key", hashing.superfast(F.col("key")).alias("h"))


def sql_steps(name: str, steps: list[str]) -> str:
    """Nested selects that apply each step to a, modulo 2**32."""
    out = "select o_orderkey, o_orderkey::bigint & 4294967295 as a from orders"
    for s in steps:
        out = f"select o_orderkey, ({s}) & 4294967295 as a from ({out})"
    return f"select o_orderkey, a as {name} from ({out})"


C1, C3 = hashing.AVALANCHE_1, hashing.AVALANCHE_HALF
SQL_AVALANCHE = {
    "h1": [f"a + {C1[0]} + (a << 12)", f"xor(xor(a, {C1[1]}), a >> 19)", f"a + {C1[2]} + (a << 5)", f"xor((a + {C1[3]}) & {MASK}, a << 9)", f"a + {C1[4]} + (a << 3)", f"xor(xor(a, {C1[5]}), a >> 16)"],
    "h2": ["a - ((a << 6) & 4294967295) + 4294967296", "xor(a, a >> 17)", "a - ((a << 9) & 4294967295) + 4294967296", "xor(a, (a << 4) & 4294967295)", "a - ((a << 3) & 4294967295) + 4294967296", "xor(a, (a << 10) & 4294967295)", "xor(a, a >> 15)"],
    "h3": [f"a + {C3[0]} + (a << 8)", f"xor(xor(a, {C3[1]}), a >> 5)", f"((a + {C3[2]}) & {MASK}) - ((a << 14) & {MASK}) + 4294967296", f"xor(xor(a, {C3[3]}), a >> 3)", f"a + {C3[4]} + (a << 7)"],
}


@query("select x.o_orderkey, h1, h2, h3 from " + " join ".join(f"({sql_steps(n, s)}) {t}" + (f" on x.o_orderkey = {t}.o_orderkey" if t != "x" else "") for t, (n, s) in zip("xyz", SQL_AVALANCHE.items(), strict=True)))
def avalanche_ints(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k, hashing.avalanche_1(k).alias("h1"), hashing.avalanche_2(k).alias("h2"), hashing.avalanche_half(k).alias("h3"))


@query(
    f"""select key, case when strlen(key) >= 5 then list_reduce(list_transform({sql_bytes("key")}[strlen(key) - 4:strlen(key) - 1], lambda b: (b + 128) % 256 - 128), lambda h, b: (h * 256 + b) & 4294967295, 0::bigint) else 0 end as h
    from ({SQL_COUNTS})"""
)
def null_hash(spark, sf_dir):
    return word_counts(spark, sf_dir).select("key", hashing.null_hash(F.col("key"), 1).alias("h"))


@query("select doc_id, ('0x' || substr(md5(text), 1, 16))::uhugeint::decimal(20,0) as h from documents")
def unsigned_parse(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", scalars.unsigned(F.concat(F.lit("0x"), F.substring(F.md5("text"), 1, 16))).alias("h"))


SQL_RUNS = """with s as (select *, (lag(event_type) over w is distinct from event_type or row_number() over w = 1)::int as starts from events window w as (partition by user_id order by ts, event_id)),
    r as (select *, sum(starts) over (partition by user_id order by ts, event_id) - 1 as run from s)
    select user_id, run::bigint as run, event_type, count(*)::bigint as length from r group by user_id, run, event_type"""


def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.run_lengths(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@query(SQL_RUNS)
def rle_runs(spark, sf_dir):
    return event_runs(spark, sf_dir)


@query("select user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as place, event_type from events")
def rle_roundtrip(spark, sf_dir):
    return sequences.expand_runs(event_runs(spark, sf_dir), ["user_id"], "event_type")


@query(
    """with d as (select user_id, event_id, event_id - coalesce(lag(event_id) over (partition by user_id order by event_id), 0) as delta from events)
    select user_id, event_id, delta, length(bin(delta))::bigint as bits from d"""
)
def delta_encode(spark, sf_dir):
    coded = sequences.deltas(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], ["event_id"], "event_id")
    return coded.withColumn("bits", sequences.bit_width(F.col("delta")).cast("long"))


@query("select user_id, event_id, event_id as value from events")
def delta_roundtrip(spark, sf_dir):
    coded = sequences.deltas(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], ["event_id"], "event_id")
    return sequences.undeltas(coded, ["user_id"], ["event_id"]).drop("delta")


@query("select user_id, array_to_string(list_sort(list(event_id)), ' ') as ids from events group by user_id")
def packed_roundtrip(spark, sf_dir):
    listed = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("ids"))
    return listed.select("user_id", F.array_join(packing.unpacked(packing.packed(F.col("ids"))), " ").alias("ids"))


@query("select doc_id, md5(text) as m from documents")
def zlib_roundtrip(spark, sf_dir):
    back = packing.uncompressed(packing.compressed(F.encode("text", "UTF-8")))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(back).alias("m"))


SQL_WAVE = "sqrt(2.0 / 32) * cos(pi() / 32 * {0} * ({1} + 0.5))"
#: Which value of a vector an image of 32 columns has at a place: no row repeats.
PIXEL = "(i % 32) * (i // 32 + 3) + (i // 32) * (i // 32)"


@query(f"""with p as (select vec_id, i // 32 as y, i % 32 as x, embedding[({PIXEL})::int % len(embedding) + 1]::double as e from embeddings, range({IMAGE_SIDE * IMAGE_SIDE}) as r(i) where len(embedding) > 0),
    a as (select vec_id, y, v, sum(e * {SQL_WAVE.format("v", "x")}) as e from p, range(1, 9) as r(v) group by all),
    f as (select vec_id, u, v, sum(e * {SQL_WAVE.format("u", "y")}) as e from a, range(1, 9) as r(u) group by all),
    m as (select vec_id, median(e) as mid from f group by vec_id),
    b as (select vec_id, string_agg(case when e > mid then '1' else '0' end, '' order by u, v) as bits from f join m using (vec_id) group by vec_id)
    select vec_id, bits from b""")
def perceptual_bits(spark, sf_dir):
    """The hash of an image of each vector's values."""
    vectors = table(spark, sf_dir, "embeddings").where(F.size("embedding") > 0)
    place = lambda i: (i % IMAGE_SIDE) * (F.floor(i / IMAGE_SIDE) + 3) + F.floor(i / IMAGE_SIDE) * F.floor(i / IMAGE_SIDE)
    image = F.transform(F.sequence(F.lit(0), F.lit(IMAGE_SIDE * IMAGE_SIDE - 1)), lambda i: F.get("embedding", (place(i) % F.size("embedding")).cast("int")))
    return vectors.select("vec_id", F.reverse(F.lpad(F.bin(sequences.perceptual_hash(image, IMAGE_SIDE)), 64, "0")).alias("bits"))


@query(f"select array_to_string({sql_tokens('text', tokens.BLANKS)}, '|') as fields, doc_id from documents where len({sql_tokens('text', tokens.BLANKS)}) > 0")
def blank_fields(spark, sf_dir):
    cut = table(spark, sf_dir, "documents").select(tokens.tokens(F.col("text"), tokens.BLANKS).alias("fields"), "doc_id")
    return cut.where(F.size("fields") > 0).withColumn("fields", F.array_join("fields", "|"))


@query(f"select key || chr(9) || n as value from ({SQL_COUNTS})")
def text_result(spark, sf_dir):
    return sinks.text_rows(word_counts(spark, sf_dir).select("key", "n"), "\t")


@query(f"""select lower(hex(encode(lpad(hex(strlen(j)), 8, '0') || j))) as row from (select '{{"key":' || to_json(key) || ',"n":' || n || '}}' as j from ({SQL_COUNTS}))""")
def prefixed_result(spark, sf_dir):
    rows = sinks.length_prefixed(word_counts(spark, sf_dir).select("key", "n"))
    # the length's own bytes are shown as hexadecimal digits, as SQL text has no zero bytes
    shown = F.concat(F.hex(F.encode(F.hex(F.substring("value", 1, 4)), "UTF-8")), F.hex(F.expr("substring(value, 5, length(value))")))
    return rows.select(F.lower(shown).alias("row"))


@query(f"select key, count(*)::bigint as n from (select unnest({sql_tokens('text')}) as key from (select text from documents union all select text from benchmark)) group by key")
def union_count(spark, sf_dir):
    both = table(spark, sf_dir, "documents").select("text").unionByName(table(spark, sf_dir, "benchmark").select("text"))
    return Job("word_count", both).run(spark)


@query(f"select row_number() over (partition by (({SQL_BYTE_SUM}) % {PARTITIONS} + {PARTITIONS}) % {PARTITIONS} order by key) as place, key, n from ({SQL_COUNTS})")
def sorted_partitions(spark, sf_dir):
    return sinks.placed(sinks.with_partition(word_counts(spark, sf_dir), PARTITIONS), "pid", "key").select("place", "key", "n")


def _created(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"key": rows["event_type"], "n": 1, "total": rows["value"].fillna(0.0), "high": rows["value"]})


def _merged(partials: pd.DataFrame) -> pd.DataFrame:
    return partials.groupby("key", as_index=False, sort=False).agg(n=("n", "sum"), total=("total", "sum"), high=("high", "max"))


EVENT_TOTALS = PythonAgg(create=_created, merge=_merged, schema="key string, n long, total double, high double")


@query("select event_type as key, count(*)::bigint as n, round(sum(coalesce(value, 0)), 4) as total, max(value) as high from events where event_type is not null group by event_type")
def custom_agg(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("event_type is not null").select("event_type", "value")
    return Job(EVENT_TOTALS, rows).run(spark).withColumn("total", F.round("total", 4))


@udtf(returnType="name string, number long")
class Properties:
    """The whole numbers in a flat JSON object, by name."""

    def eval(self, text: str):
        import json

        for name, value in json.loads(text or "{}").items():
            if isinstance(value, int):
                yield name, value


@query("select event_id, 'k' as name, json_extract_string(props, '$.k')::bigint as number from events where json_extract_string(props, '$.k') is not null")
def custom_udtf(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "props")
    return rows.lateralJoin(Properties(F.col("props").outer())).select("event_id", "name", "number")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from foldmill.plans import stored  # noqa: F401  registers its queries

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
