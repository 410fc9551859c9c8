"""Homomorphic multiset fingerprints of documents.

A paragraph is hashed to a wide vector and a document is the sum of its paragraphs' vectors modulo
2**32 a lane. So the order of paragraphs does not matter, and inserting or deleting one is an
addition or a subtraction. DIGEST lanes are uniform numbers that make unequal documents unequal;
the SIGN lanes add up +1 or -1 for each word shingle of the paragraph, so the cosine of two
documents' sign lanes estimates how much they share. Only column expressions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from floodsift.llm.words import ascii_lower, let, shingle_hashes, words
from floodsift.operators.ordering import positions
from floodsift.session import settle, stage

DIGEST = 16
SIGN = 64
SHINGLE = 3
LANE = (1 << 32) - 1
PAIR = (1 << 32) + 1  # picks a bit of each half of a 64-bit number


def _paragraphs(text: Column) -> Column:
    """Paragraphs end at line feeds; a null chunk has none, an empty one has an empty paragraph."""
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.split(text, "\n"))


def _digest_lanes(paragraphs: Column) -> Column:
    """Sums of the paragraphs' uniform vectors modulo 2**32."""
    pairs = F.transform(
        paragraphs, lambda p: F.struct(F.xxhash64(p).alias("a"), F.xxhash64(F.lit(9), p).alias("b"))
    )

    def lane(of: Column, k: Column) -> Column:
        total = F.aggregate(
            of, F.lit(0).cast("bigint"), lambda s, p: s + F.xxhash64(p["a"], p["b"], k).bitwiseAND(LANE)
        )
        return total.bitwiseAND(LANE)

    return let(pairs, lambda of: F.transform(F.sequence(F.lit(0), F.lit(DIGEST - 1)), lambda k: lane(of, k)))


def _shingles(paragraphs: Column) -> Column:
    return F.flatten(
        F.transform(paragraphs, lambda p: shingle_hashes(words(ascii_lower(p)), SHINGLE))
    )


def _sign_sums(hash_: Column, counted: Column, name: str) -> list[Column]:
    """Aggregates: how many hashes set each bit, two bits a column, and how many there are."""
    sums = [
        F.sum(F.when(counted, F.shiftright(hash_, k).bitwiseAND(PAIR))).alias(f"{name}{k}")
        for k in range(SIGN // 2)
    ]
    return [*sums, F.count(F.when(counted, hash_)).alias(f"{name}_n")]


def _sign_lanes(name: str) -> Column:
    """Ones minus zeros of every bit."""
    n = F.col(f"{name}_n")
    halves = F.array(*[F.coalesce(F.col(f"{name}{k}"), F.lit(0).cast("bigint")) for k in range(SIGN // 2)])
    low = F.transform(halves, lambda s: s.bitwiseAND(LANE) * 2 - n)
    high = F.transform(halves, lambda s: F.shiftrightunsigned(s, 32) * 2 - n)
    return F.concat(low, high)


def _sum_lanes(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x + y).bitwiseAND(LANE))


def insert(digest: Column, text: Column) -> Column:
    """Digest lanes of a text that also has the paragraphs of ``text``; null has none."""
    return _sum_lanes(digest, _digest_lanes(_paragraphs(text)))


def delete(digest: Column, text: Column) -> Column:
    """Digest lanes of a text without the paragraphs of ``text``, which it must have; undoes :func:`insert`."""
    return F.zip_with(digest, _digest_lanes(_paragraphs(text)), lambda x, y: (x - y).bitwiseAND(LANE))


def as_text(digest: Column, sign: Column) -> Column:
    """Eight lower-case hexadecimal digits a lane."""
    lanes = F.concat(digest, F.transform(sign, lambda v: v.bitwiseAND(LANE)))
    return F.array_join(F.transform(lanes, lambda v: F.lower(F.lpad(F.hex(v), 8, "0"))), "")


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def likeness(digest_a: Column, sign_a: Column, digest_b: Column, sign_b: Column) -> Column:
    """1 for equal fingerprints, else the cosine of the sign lanes, 0 if negative or undefined."""
    norms = F.sqrt(_dot(sign_a, sign_a) * _dot(sign_b, sign_b))
    cosine = F.when(norms > 0, _dot(sign_a, sign_b) / norms).otherwise(F.lit(0.0))
    same = (digest_a == digest_b) & (sign_a == sign_b)
    return F.when(same, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)))


def with_next(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Documents with a key, and (key, next key, repeats) in the order of ids and then texts.

    Rows of one id and one text are one document, ``_repeats`` times. Null ids come first.
    """
    keyed = docs.select(
        F.col(id_col).isNotNull().alias("_has"),
        F.coalesce(F.col(id_col), F.lit(0)).cast("bigint").alias("_id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("_hash"),
        F.coalesce("text", F.lit("")).alias("_text"),
    )
    key = ["_has", "_id", "_hash"]
    ids = keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("_repeats"), F.max(F.length("_text")).cast("bigint").alias("_n"))
    placed = settle(positions(ids, [], key, "_at"))
    total = placed.count()
    after = placed.select(
        F.pmod(F.col("_at") - 1, F.lit(max(total, 1))).alias("_at"),
        *[F.col(k).alias(f"_next{k}") for k in key],
    )
    order = settle(placed.join(after, "_at").drop("_at"))
    if not order.where("_repeats > 1").isEmpty():
        keyed = keyed.dropDuplicates(key)
    return keyed, order


def edited(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Key, next key, _n, _repeats, _text and _edited of every document.

    The last quarter of the code points is replaced by as many first ones of the next document.
    """
    key = ["_has", "_id", "_hash"]
    keyed, order = with_next(docs, id_col)
    quarter = F.floor(F.col("_n") / 4).cast("int")
    heads = (
        keyed.select(*[F.col(k).alias(f"_next{k}") for k in key], "_text")
        .join(order, [f"_next{k}" for k in key])
        .select(*key, F.substring("_text", F.lit(1), quarter).alias("_head"))
    )
    return (
        keyed.join(order, key)
        .join(heads, key)
        .withColumn("_kept", F.substring("_text", F.lit(1), (F.col("_n") - quarter).cast("int")))
        .withColumn("_edited", F.concat("_kept", "_head"))
    )


def fingerprints(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Key, next key, _n, _repeats, _sha and the lanes of each text and of its edited text.

    Paragraphs before the edit are hashed once and added to both; the paragraphs that the edit
    deletes go to the text alone, those that it inserts to the edited text alone.
    """
    key = ["_has", "_id", "_hash", "_next_has", "_next_id", "_next_hash", "_n", "_repeats"]
    whole = edited(docs, id_col).withColumn("_cut", F.length("_kept") - F.coalesce(
        F.length(F.substring_index("_kept", "\n", -1)), F.lit(0)))
    stable = F.when(F.col("_cut") > 0, F.substring("_text", F.lit(1), F.col("_cut") - 1))
    rest = F.col("_cut") + 1
    chunks = whole.select(
        *key,
        F.sha2("_edited", 256).alias("_sha"),
        _paragraphs(stable).alias("_both"),
        _paragraphs(F.substring("_text", rest, F.lit(1 << 30))).alias("_old"),
        _paragraphs(F.substring("_edited", rest, F.lit(1 << 30))).alias("_new"),
    )
    key.append("_sha")
    lanes = chunks.select(
        *key,
        *[_digest_lanes(F.col(c)).alias(f"_digest{c}") for c in ("_both", "_old", "_new")],
        *[_shingles(F.col(c)).alias(f"_shingles{c}") for c in ("_both", "_old", "_new")],
    ).select(
        *key,
        _sum_lanes(F.col("_digest_both"), F.col("_digest_old")).alias("_digest"),
        _sum_lanes(F.col("_digest_both"), F.col("_digest_new")).alias("_edited_digest"),
        F.concat("_shingles_both", "_shingles_old", "_shingles_new").alias("_h"),
        F.size("_shingles_both").alias("_m"),
        F.size("_shingles_old").alias("_o"),
    )
    key += ["_digest", "_edited_digest", "_m", "_o"]
    counted = lanes.select(*key, F.posexplode_outer("_h").alias("_p", "_x"))
    is_text = F.col("_p") < F.col("_m") + F.col("_o")
    is_edited = (F.col("_p") < F.col("_m")) | ~is_text
    sums = counted.groupBy(*key).agg(
        *_sign_sums(F.col("_x"), is_text, "t"), *_sign_sums(F.col("_x"), is_edited, "e")
    )
    return sums.select(
        *key[:-2], _sign_lanes("t").alias("_sign"), _sign_lanes("e").alias("_edited_sign")
    )


def compare(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Fingerprints of texts and edited texts, and their likeness to the edit and the next document.

    A null text is empty. A single document is its own next one. An empty table gives none.
    """
    found = stage(fingerprints(docs, id_col))
    after = found.select(
        *[F.col(k).alias(f"_next{k}") for k in ("_has", "_id", "_hash")],
        F.col("_digest").alias("_next_digest"),
        F.col("_sign").alias("_next_sign"),
    )
    rows = found.join(after, ["_next_has", "_next_id", "_next_hash"])
    out = rows.select(
        F.when(F.col("_has"), F.col("_id")).alias(id_col),
        F.col("_n").alias("n_chars"),
        F.col("_sha").alias("edited_sha256"),
        as_text(F.col("_digest"), F.col("_sign")).alias("fingerprint"),
        as_text(F.col("_edited_digest"), F.col("_edited_sign")).alias("edited_fingerprint"),
        likeness(*map(F.col, ("_digest", "_sign", "_edited_digest", "_edited_sign"))).alias("near_edited"),
        likeness(*map(F.col, ("_digest", "_sign", "_next_digest", "_next_sign"))).alias("near_next"),
        F.explode(F.array_repeat(F.lit(1), F.col("_repeats").cast("int"))).alias("_one"),
    )
    return out.drop("_one")
