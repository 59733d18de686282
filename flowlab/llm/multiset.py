"""Order-independent fingerprints of documents: a homomorphic multiset hash over paragraphs.

A paragraph (a line of the text) is hashed to a wide vector, and a document's fingerprint is the sum of
its paragraphs' vectors modulo powers of two. Sums don't depend on the order of paragraphs, and a
paragraph is inserted or deleted by adding or subtracting its vector (``added``, ``removed``).

The vector has two kinds of lanes. Equality lanes (modulo 2**32) are uniform: they are drawn from the
SHA-256 of the paragraph, so unequal bags of paragraphs hardly ever agree in all of them. Likeness lanes
(modulo 2**16) hold a sign, +1 or -1, for each clause of the paragraph; the products of two documents'
lanes then add up to about the number of clauses they share. Everything is Spark SQL: no worker runs
Python."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from flowlab.llm.frames import partitions_for
from flowlab.tables import ref, tick

# Equality lanes and their bits; likeness lanes come 64 to a hash, with their bits.
EQUAL, EQUAL_BITS = 16, 32
HASHES, LIKE_BITS = 4, 16
LIKE = 64 * HASHES
# A paragraph is cut into clauses at blanks behind these marks (SQL text of a pattern).
CLAUSE = r"(?<=[.!?;:,]) +|\n"
# Ranges of documents per shuffle partition, so that ranges fill partitions evenly.
RANGES = 4


def _let(name, value, body):
    """SQL of ``body`` with a lambda variable bound to ``value``, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _vector_sql(text):
    digests = f"if({text} = '', cast(array() as array<string>), transform(split({text}, '\\n'), p -> sha2(p, 256)))"
    low = (1 << EQUAL_BITS) - 1
    equal = _let("ds", digests, f"transform(sequence(0, {EQUAL - 1}), i -> "
                                f"aggregate(ds, 0L, (a, d) -> a + (xxhash64(d, i) & {low}L)) & {low}L)")
    # bits i and 32 + i of all hashes are counted in the two halves of a long; set bits count +1, others -1
    lane = "pmod(2L * ({}) - size(hs), " + f"{1 << LIKE_BITS}L)"
    lanes = _let("n", "aggregate(hs, 0L, (a, h) -> a + (shiftright(h, i) & 4294967297L))",
                 f"array({lane.format('n & 4294967295L')}, {lane.format('shiftrightunsigned(n, 32)')})")
    signs = _let("hs", "transform(cs, c -> xxhash64(c, s))", f"flatten(transform(sequence(0, 31), i -> {lanes}))")
    clauses = f"filter(split({text}, '{CLAUSE}'), c -> c <> '')"
    like = _let("cs", clauses, f"flatten(transform(sequence(0, {HASHES - 1}), s -> {signs}))")
    return f"concat({equal}, {like})"


def vector(column):
    """The vector (array<long>) of a text column named ``column``; null and empty texts have no paragraph."""
    return F.expr(_let("t", f"coalesce({tick(column)}, '')", _vector_sql("t")))


def _moduli():
    return F.array(*[F.lit(1 << EQUAL_BITS)] * EQUAL, *[F.lit(1 << LIKE_BITS)] * LIKE)


def added(left, right):
    """The vector of both documents' paragraphs together."""
    return F.zip_with(F.zip_with(left, right, lambda a, b: a + b), _moduli(), F.pmod)


def removed(left, right):
    """The vector of the left document without the paragraphs of the right."""
    return F.zip_with(F.zip_with(left, right, lambda a, b: a - b), _moduli(), F.pmod)


def written(lanes):
    """A vector as text: lanes in order, 8 hexadecimal digits an equality lane, 4 a likeness lane."""
    return F.lower(F.concat(
        F.array_join(F.transform(F.slice(lanes, 1, EQUAL), lambda x: F.lpad(F.hex(x), EQUAL_BITS // 4, "0")), ""),
        F.array_join(F.transform(F.slice(lanes, EQUAL + 1, LIKE), lambda x: F.lpad(F.hex(x), LIKE_BITS // 4, "0")), "")))


def read(text):
    """The vector that ``written`` put down."""
    def run(first, lanes, digits):
        return F.transform(F.sequence(F.lit(0), F.lit(lanes - 1)), lambda i: F.conv(
            F.substring(text, F.lit(first + 1) + i * digits, F.lit(digits)), 16, 10).cast("long"))

    return F.concat(run(0, EQUAL, EQUAL_BITS // 4), run(EQUAL * EQUAL_BITS // 4, LIKE, LIKE_BITS // 4))


def likeness(left, right):
    """Share of common clauses of two vectors, 0 to 1: twice the products of likeness lanes over the
    squares of both. Exact for equal vectors (1); otherwise an estimate whose standard error is about
    1 / sqrt(LIKE). Two vectors without clauses are alike. Above 2**15 clauses lanes can wrap, which
    leaves equality as it is and blurs the estimate."""
    half, whole = 1 << LIKE_BITS - 1, 1 << LIKE_BITS

    def signed(x):
        return F.when(x >= half, x - whole).otherwise(x)

    def dot(a, b):
        return F.aggregate(F.zip_with(F.slice(a, EQUAL + 1, LIKE), F.slice(b, EQUAL + 1, LIKE),
                                      lambda x, y: signed(x) * signed(y)), F.lit(0).cast("long"), lambda s, x: s + x)

    share = F.try_divide(2.0 * dot(left, right), dot(left, left) + dot(right, right))
    return F.when(left == right, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(share, F.lit(1.0)))))


def _first_keys(docs):
    """The first sort key of each range of ids, ascending: a long per range, whatever the rows."""
    n = RANGES * partitions_for(docs.sparkSession)
    keys = docs.select(F.bitwise_not(F.col("doc_id").cast("long")).alias("key")).where("key is not null")
    firsts = keys.repartitionByRange(n, "key").groupBy(F.spark_partition_id()).agg(F.min("key").alias("key"))
    return sorted({r["key"] for r in firsts.collect()})


def in_order(docs):
    """doc_id, text and the next document's text and vector, by descending doc_id (rows without an id
    last, rows of one id by their texts' hash); after the last comes the first.

    Ids are cut into ranges by numbers known beforehand, found by binary search in each row. The first
    row of a range also travels as a guest to the end of the range before, so that texts are shuffled
    once and no join is needed. Rows of one id stand in one range."""
    firsts = _first_keys(docs)
    steps = [1 << k for k in reversed(range(max(len(firsts) - 1, 1).bit_length()))]
    bounds = F.expr("array(" + ", ".join(f"{x}L" if x > -(1 << 63) else "-9223372036854775807L - 1L" for x in firsts or [0]) + ")")
    key = F.col("_key")

    def reach(at, step):
        return F.when((at + step < len(firsts)) & (F.try_element_at(bounds, at + step + 1) <= key), at + step).otherwise(at)

    place = F.when(key.isNull(), max(len(firsts) - 1, 0)).otherwise(
        F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), reach))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"),
                       F.bitwise_not(F.col("doc_id").cast("long")).alias("_key")).withColumn("_place", place)
    home = F.struct(F.col("_place").alias("_range"), F.lit(False).alias("_guest"))
    if len(firsts) > 1:
        before = F.struct(F.pmod(F.col("_place") - 1, F.lit(len(firsts))).alias("_range"), F.lit(True).alias("_guest"))
        first = F.try_element_at(bounds, F.col("_place") + 1) == key
        seats = F.when(first, F.array(home, before)).otherwise(F.array(home))
    else:
        seats = F.array(home)
    # hashing costs more than its bytes tell, so the number of tasks isn't left to their size
    rows = rows.select("doc_id", "text", "_key", F.inline(seats)).repartition(partitions_for(docs.sparkSession), "_range")
    order = Window.partitionBy("_range").orderBy("_guest", F.col("_key").isNull(), "_key", F.xxhash64("text"))
    return (rows.withColumn("next_text", F.lead("text").over(order)).withColumn("vector", vector("text"))
            .withColumns({"next_vector": F.lead("vector").over(order),
                          "_opening": F.first(F.struct("text", "vector")).over(order)})
            .where("not _guest")
            .select("doc_id", "text", "vector", F.coalesce("next_text", "_opening.text").alias("next_text"),
                    F.coalesce("next_vector", "_opening.vector").alias("next_vector")))


def edited_likeness(docs):
    """Every row of ``docs`` (doc_id, text; other columns are ignored) with its fingerprint and that of
    its edited text: the last half of its characters, rounded down, replaced by as many first characters
    of the next document (all of them if it is shorter).

    Null texts count as empty; a single row is its own next document; repeated rows and ids stay, each
    followed by the next row in the order of ``in_order``; an empty table gives no rows. Returns doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")),
                      F.substring("next_text", F.lit(1), half))
    rows = in_order(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(
        "doc_id", "n_chars", "vector", "next_vector", edited.alias("edited"))
    rows = rows.withColumn("edited_vector", vector("edited"))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        written(ref("vector")).alias("fingerprint"), written(ref("edited_vector")).alias("edited_fingerprint"),
        likeness(ref("vector"), ref("edited_vector")).alias("near_edited"),
        likeness(ref("vector"), ref("next_vector")).alias("near_next"))
