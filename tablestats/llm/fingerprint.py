"""Document fingerprints that add up: a homomorphic multiset hash over paragraphs.

A paragraph (what ``\\n`` separates) hashes to a wide vector; a document's
fingerprint is the sum of its paragraphs' vectors, lane by lane, modulo a power of
two. So the order of paragraphs does not matter, and inserting or deleting one
adds or subtracts its vector (``combine``, ``without``).

Lanes, each modulo 2^32:

* ``IDENTITY`` lanes hashed from the whole paragraph: two documents are the same
  multiset of paragraphs if and (but for a chance of 2^-256) only if these agree.
* ``SKETCH`` lanes that count, over the paragraph's pieces (two neighbouring
  words, and the last word), the pieces whose hash has that lane's bit set; and
  one lane that counts pieces. Twice a count less the number of pieces is a sum of
  random signs, so products of two documents' lanes estimate how many pieces
  they share, whatever the order: ``likeness`` is twice that over the pieces of both.

DataFrame functions only. Pieces are summed where they are read, several lanes
packed in one long; blocks of pieces too small to overflow a packed lane are
unpacked and added modulo 2^32 afterwards.

Edge cases: a null text counts as empty (one empty paragraph, no pieces); two
documents without pieces have likeness 1 if their fingerprints agree, else 0;
null ids sort last in descending order; repeated ids are ordered by text, those of an id
with very many rows by a hash of the text; a single document is followed by itself; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablestats.llm.common import column, written

IDENTITY = 8
PACKED = 21  # longs of three packed lanes, one for each of 21 bit positions
SKETCH = 3 * PACKED
LANES = IDENTITY + SKETCH + 1
#: Three lanes of 21 bits in a long.
_MASK = 1 | 1 << 21 | 1 << 42
#: Paragraphs, and pieces of a paragraph, in a block: 64 * 16384 pieces stay below 2^21.
BLOCK_PARAGRAPHS, BLOCK_BITS = 64, 14
#: Documents in a group whose neighbours one task looks up, the id quantiles that groups are cut by, and
#: the most groups: one small row of each is broadcast; with more documents groups grow.
GROUP, KNOTS, MAX_GROUPS = 200, 256, 1 << 20
_MOD = 0xFFFFFFFF
_SPACES = r"[\x20\x09-\x0D]+"
_LAST = -(2**63)


def _mod(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_MOD))


def paragraphs(text: Column) -> Column:
    return F.split(text, "\n", -1)


def identity_lanes(text: Column) -> Column:
    """The identity lanes of a text, array<long>."""
    def of(p: Column) -> Column:
        hashes = [F.xxhash64(F.lit(i), p) for i in range(IDENTITY // 2)]
        return F.array(*[lane for h in hashes for lane in (_mod(h), F.shiftrightunsigned(h, 32))])

    zero = F.array(*[F.lit(0).cast("long")] * IDENTITY)
    return F.aggregate(paragraphs(text), zero, lambda acc, p: combine(acc, of(p)))


def combine(a: Column, b: Column) -> Column:
    """Lanes of both documents' paragraphs together."""
    return F.zip_with(a, b, lambda x, y: _mod(x + y))


def without(a: Column, b: Column) -> Column:
    """Lanes of ``a`` after deleting the paragraphs of ``b``."""
    return F.zip_with(a, b, lambda x, y: _mod(x - y))


def to_text(lanes: Column) -> Column:
    """The fingerprint as hex digits."""
    return F.array_join(F.transform(lanes, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the estimated share of pieces that two documents (their lanes) have in common."""
    def signed(x: Column) -> Column:  # a lane as the number nearest zero
        return F.when(_mod(x) >= 1 << 31, _mod(x) - (1 << 32)).otherwise(_mod(x)).cast("double")

    def signs(v: Column) -> Column:
        return F.transform(F.slice(v, IDENTITY + 1, SKETCH), lambda c: signed(2 * c - F.element_at(v, LANES)))

    def square(v: Column) -> Column:
        return F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)

    both = F.aggregate(F.zip_with(signs(a), signs(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    own = square(signs(a)) + square(signs(b))
    return F.when(a == b, 1.0).when(own == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * both / own)))


def sketches(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` (unique in ``rows``) and ``sketch``: the sketch lanes and the number of pieces, array<long>."""
    words = F.transform(F.filter(F.split("paragraph", _SPACES), lambda w: w != ""), lambda w: F.xxhash64(w))
    pieces = (rows.select(*keys, F.posexplode(paragraphs(F.col(text))).alias("at", "paragraph"))
              .select(*keys, F.floor(F.col("at") / BLOCK_PARAGRAPHS).cast("int").alias("block"), words.alias("words"))
              # The last word's neighbour is null, which leaves its hash as it is.
              .select(*keys, "block", F.posexplode_outer(F.zip_with("words", F.slice("words", F.lit(2), F.size("words")), lambda a, b: F.xxhash64(a, b))).alias("at", "h")))
    sums = [F.coalesce(F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(_MASK))), F.lit(0)).alias(f"s{i}") for i in range(PACKED)]
    blocks = pieces.groupBy(*keys, "block", F.shiftright("at", BLOCK_BITS).alias("part")).agg(*sums, F.count("h").alias("n"))
    parts = blocks.groupBy(*keys).agg(F.collect_list(F.struct(*[f"s{i}" for i in range(PACKED)], "n")).alias("parts"))
    unpack = lambda p: F.array(*[F.shiftrightunsigned(p[f"s{i}"], 21 * k).bitwiseAND(F.lit((1 << 21) - 1)) for i in range(PACKED) for k in range(3)], p["n"])
    # Nearly every document is one block; those of longer ones are added.
    return parts.select(*keys, F.aggregate(F.transform(F.slice("parts", F.lit(2), F.size("parts")), unpack), unpack(F.element_at("parts", 1)), combine).alias("sketch"))


def fingerprint_lanes(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """``keys`` (unique in ``docs``) and ``lanes``, which ``combine``, ``without``, ``likeness`` and ``to_text`` take."""
    rows = docs.select(*keys, F.coalesce(column(docs, text_col).cast("string"), F.lit("")).alias("__text"))
    rows = rows.withColumn("__identity", to_text(identity_lanes(F.col("__text"))))
    return sketches(rows, [*keys, "__identity"], "__text").select(*keys, F.concat(_from_text("__identity"), "sketch").alias("lanes"))


def _from_text(name: str, lanes: int = IDENTITY) -> Column:
    return F.array(*[F.conv(F.substring(name, 8 * i + 1, 8), 16, 10).cast("long") for i in range(lanes)])


def followed(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, text) with the next row in descending order of doc_id, and a key (g, i) for each.

    Adds g, i, next_text, next_g, next_i. The ids are cut into groups of about
    ``GROUP`` by quantiles; an id that several quantiles fall on is cut further, by a hash of
    text and row. Each group's first row also goes to the group before
    it, so every row finds its next in its own group, in one shuffle.
    """
    rows = rows.withColumn("k", F.coalesce("doc_id", F.lit(_LAST))).withColumn("row", F.monotonically_increasing_id())
    n, knots = rows.agg(F.count(F.lit(1)), F.percentile_approx("k", [i / KNOTS for i in range(KNOTS + 1)], 10_000)).first()
    # As many stretches between quantiles as hold a group each.
    m = max(1, min(KNOTS, n // GROUP))
    knots = [knots[i * KNOTS // m] for i in range(m + 1)] if knots else [0]
    # Each stretch between two quantiles has the same number of groups; so has each stretch that is one id alone.
    each = max(1, min(MAX_GROUPS, -(-n // GROUP)) // max(1, len(knots) - 1))
    ids = sorted(set(knots))
    alone = [knots.count(x) - 1 for x in ids]
    first = [each * (i + sum(alone[:i])) for i in range(len(ids))]
    at = F.greatest(F.size(F.filter(F.lit(ids), lambda x: x <= F.col("k"))), F.lit(1))
    low, high = F.element_at(F.lit(ids), at).cast("double"), F.element_at(F.lit(ids), F.least(at + 1, F.lit(len(ids)))).cast("double")
    share = F.when(high > low, (F.col("k").cast("double") - low) / (high - low)).otherwise(F.lit(0.0))
    own = F.element_at(F.lit(alone), at)
    # u orders the rows of an id that is cut: by the text's hash, equal texts (whose order changes nothing) by the row's.
    u = F.shiftleft(F.shiftrightunsigned(F.xxhash64("text"), 32), 21) + F.shiftrightunsigned(F.xxhash64("row"), 43)
    cut = (F.col("k") == F.element_at(F.lit(ids), at)) & (own > 0)
    rows = rows.withColumn("u", F.when(cut, u).otherwise(0))
    by_hash = F.floor(F.col("u") / 2.0**53 * (own * each)).cast("int")
    by_id = own * each + F.greatest(F.lit(0), F.least(F.lit(each - 1), F.floor(share * each).cast("int")))
    g = F.element_at(F.lit(first), at) + F.when(cut, by_hash).otherwise(by_id)
    rows = rows.withColumn("g", g.cast("int"))
    # At most MAX_GROUPS rows (and the quantiles), whatever the data's size.
    tops = rows.groupBy("g").agg(F.max(F.struct("k", "u")).alias("top"))
    above = F.lead("g").over(W.orderBy("g"))
    tops = tops.select("g", "top", F.coalesce(above, F.min("g").over(W.orderBy("g").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("to"))
    places = F.when(F.struct("k", "u") == F.col("top"), F.array(F.struct(F.col("g").alias("p"), F.lit(0).alias("guest")), F.struct(F.col("to").alias("p"), F.lit(1).alias("guest")))).otherwise(F.array(F.struct(F.col("g").alias("p"), F.lit(0).alias("guest"))))
    dealt = rows.join(F.broadcast(tops), "g").withColumn("place", F.explode(places)).select("doc_id", "text", "k", "u", "g", F.col("place.p").alias("p"), F.col("place.guest").alias("guest"))
    w = W.partitionBy("p").orderBy("guest", F.col("k").desc(), F.col("u").desc(), "text")
    out = dealt.select("doc_id", "text", "g", "guest", F.row_number().over(w).alias("i"), F.lead("text").over(w).alias("next_text"), F.lead("g").over(w).alias("next_g"), F.lead("guest").over(w).alias("next_guest"))
    return out.where("guest = 0").select("doc_id", "text", "g", "i", "next_text", "next_g", F.when(F.col("next_guest") == 1, 1).otherwise(F.col("i") + 1).alias("next_i"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text and their likenesses.

    The edited text has the last half of the characters replaced by the first as
    many of the next document in descending order of id.
    """
    rows = docs.select(column(docs, id_col).cast("long").alias("doc_id"), F.coalesce(column(docs, text_col).cast("string"), F.lit("")).alias("text"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = followed(rows).withColumn("n_chars", F.char_length("text").cast("long"))
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half))
    own = ["doc_id", "g", "i", "next_g", "next_i", "n_chars"]
    # Both texts of a document in one pass: role 0 its own, role 1 the edited one.
    both = rows.select(*own, F.posexplode(F.array(F.col("text"), edited)).alias("role", "t"))
    both = both.select(*own, "role", "t", F.when(F.col("role") == 1, F.sha2("t", 256)).alias("edited_sha256"), to_text(identity_lanes(F.col("t"))).alias("identity"))
    keys = [*own, "role", "edited_sha256", "identity"]
    lanes = written(sketches(both, keys, "t").select(*own, "role", "edited_sha256", F.concat(_from_text("identity"), "sketch").alias("lanes")))
    a = lanes.where("role = 0").select("doc_id", "g", "i", "next_g", "next_i", "n_chars", F.col("lanes").alias("own"))
    b = lanes.where("role = 1").select("g", "i", "edited_sha256", F.col("lanes").alias("new"))
    c = lanes.where("role = 0").select(F.col("g").alias("next_g"), F.col("i").alias("next_i"), F.col("lanes").alias("next"))
    return (a.join(b, ["g", "i"]).join(c, ["next_g", "next_i"])
            .select("doc_id", "n_chars", "edited_sha256", to_text(F.col("own")).alias("fingerprint"), to_text(F.col("new")).alias("edited_fingerprint"),
                    likeness(F.col("own"), F.col("new")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next")))
