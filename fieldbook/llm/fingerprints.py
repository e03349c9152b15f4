"""Document fingerprints: SpotSigs.

Common words are anchors, and so is the beginning of a text. At each anchor a signature is taken: the anchor and the chain of
the next ``CHAIN`` content words, common words between them skipped (``SKIP`` at most before each word; at the end of a text
fewer). A fingerprint is the set of a text's signatures. A text without any letter or digit has one signature, the text
itself. Only the empty text has an empty fingerprint.

Near duplicates: equal sets are one class. A class orders its signatures from rare to frequent; two sets of likeness
``least`` share one among the first of both. Classes are put into partitions by set length, so that sets in partitions further
apart than neighbours cannot reach the likeness, and meet under a signature and a partition. Under each of these the classes
are compared with one of them first; only where different groups still meet are pairs of them compared, pruned by their
lengths and by what their places in the order leave to share, and then by exact Jaccard.

Built-in functions only. Null text is empty; two empty sets have likeness 1, an empty and another 0, and are near nothing. A
null doc_id sorts first; rows with equal ids follow each other by a hash of their text. Extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbook.llm.components import components
from fieldbook.llm.storage import documents_only, written
from fieldbook.operators.history import Framed, add_history
from fieldbook.operators.segments import Layout

#: Common words of English, German, French and Spanish.
ANCHORS = """the of and to in is it that for was on are as with be by this from at or an he
der die das und ist von zu den dem ein eine des als nicht mit
le la les de du et un une est que en pour qui par sur au
el los las y del al con por su se lo como""".split()
CHAIN, SKIP, LEAST = 2, 8, 0.75
_ANCHOR = "(?:" + "|".join(sorted(set(ANCHORS), key=lambda w: (-len(w), w))) + ")(?![^ ])"
_CHAIN = rf"(?: (?:{_ANCHOR} ){{0,{SKIP}}}+[^ ]++){{0,{CHAIN}}}+"
#: Group 1 is the signature; the match itself is the anchor, so that chains overlap.
SPOT = rf"(?<![^ ])(?=((?:^[^ ]++|{_ANCHOR}){_CHAIN}))(?:^[^ ]++|{_ANCHOR})"
#: Documents of a range that one task puts in order.
RANGES = Layout(segment_rows=4000, stride=64, sample_rows=8_000_000)


def signatures(text: Column, plain: Column) -> Column:
    """Sorted set of signature hashes; ``plain`` is ``plain_words(text)``."""
    chosen = F.when(text == "", F.array().cast("array<string>")).when(plain == "", F.array(text))
    chosen = chosen.otherwise(F.regexp_extract_all(plain, F.lit(SPOT), F.lit(1)))
    return F.array_sort(F.array_distinct(F.transform(chosen, lambda s: F.hash(s))))


def plain_words(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def fingerprint_text(signs: Column) -> Column:
    return F.array_join(F.transform(signs, lambda s: F.lpad(F.lower(F.hex(s.cast("long").bitwiseAND(0xFFFFFFFF))), 8, "0")), "")


def length_partition(n: Column, least: float = LEAST) -> Column:
    """Number of the set-length partition; sets of likeness ``least`` are in the same or in neighbouring ones."""
    return F.floor(F.log(F.greatest(n, F.lit(1))) / math.log(1 / least)).cast("int")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard likeness, or 0 without comparing if the lengths keep it below ``least``."""
    n, m = F.size(a), F.size(b)
    shared = F.size(F.array_intersect(a, b))
    jaccard = F.when(F.greatest(n, m) == 0, 1.0).otherwise(shared / (n + m - shared))
    return F.when(F.least(n, m) < F.greatest(n, m) * least, 0.0).otherwise(jaccard)


def _signed(docs: DataFrame) -> DataFrame:
    given = documents_only(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    return given.withColumn("plain", plain_words(F.col("text"))).withColumn("signatures", signatures(F.col("text"), F.col("plain"))).drop("plain")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, signatures, and text and signatures of the next document by doc_id (null after the last).

    Ranges are cut by a sample of ids and text hashes, so far outliers and ids that many rows share leave them alike in size.
    """
    rows = documents_only(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("hash", F.md5(F.col("text").cast("binary")))
    # plain columns: an expression over them would be shuffled beside them
    following = [Framed(f"next_{c}", lambda w, c=c: F.lead(c).over(w), after=1) for c in ("text", "signatures")]
    signed = rows.withColumn("plain", plain_words(F.col("text"))).withColumn("signatures", signatures(F.col("text"), F.col("plain"))).drop("plain")
    return add_history(signed, [], ["doc_id", "hash"], following, layout=RANGES, sampled=rows)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, signatures (set of hashes) and part (set-length partition) of every document."""
    return _signed(docs).select("doc_id", fingerprint_text(F.col("signatures")).alias("fingerprint"), "signatures", length_partition(F.size("signatures")).alias("part"))


def _first_share(n: Column, least: float) -> Column:
    """Signatures of which one is shared with any set of the likeness: all but those that may be missing."""
    return n - F.ceil(n * least - 1e-9).cast("int") + 1


def _near_pairs(met: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Of pairs (a, b) of classes those whose exact likeness is ``least`` or more."""
    one = sets.select(F.col("class").alias("a"), F.col("signatures").alias("signs_a"))
    two = sets.select(F.col("class").alias("b"), F.col("signatures").alias("signs_b"))
    both = met.distinct().join(one, "a").join(two, "b")
    return both.where(likeness(F.col("signs_a"), F.col("signs_b"), least) >= least - 1e-12).select("a", "b")


def _may_reach(least: float) -> Column:
    """Whether the likeness is possible by the lengths of two sets, and by what is left behind the places of a shared signature."""
    n, m = F.col("n"), F.col("m")
    left = 1 + F.least(n - F.col("place"), m - F.col("place_b"))
    return (F.least(n, m) >= F.greatest(n, m) * least) & (left * (1 + least) >= (n + m) * least - 1e-9)


def near_duplicates(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, n_signatures, group_id (smallest doc_id reachable by links, itself included), n_same (documents of the same set).

    Sets link from a likeness of ``least`` on. No link between different sets is missed.
    """
    signed = _signed(docs)
    signed = written(signed.select("doc_id", "signatures", F.md5(fingerprint_text(F.col("signatures")).cast("binary")).alias("class")), "spot-signed")
    some = signed.where(F.size("signatures") > 0)
    sets = written(some.groupBy("class").agg(F.first("signatures").alias("signatures"), F.size(F.first("signatures")).alias("n")), "spot-sets")
    each = sets.select("class", "n", F.explode("signatures").alias("sign"))
    common = written(each.groupBy("sign").agg(F.count(F.lit(1)).alias("often")).where("often > 1"), "spot-common")
    # a signature of one class meets nothing; it still counts as a rare one, at the front of the order
    placed = each.join(common, "sign").groupBy("class", "n").agg(F.array_sort(F.collect_list(F.struct("often", "sign"))).alias("order"))
    place = F.col("n") - F.col("many") + F.col("at") + 1
    first = placed.select("class", "n", F.size("order").alias("many"), F.posexplode("order").alias("at", "o")).select("class", "n", F.col("o.sign").alias("sign"), place.alias("place"))
    first = written(first.where(F.col("place") <= _first_share(F.col("n"), least)).withColumn("part", length_partition(F.col("n"), least)), "spot-index")

    smaller = first.select("sign", F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"), F.col("class").alias("a"), "n", "place")
    larger = first.select("sign", "part", F.col("class").alias("b"), F.col("n").alias("m"), F.col("place").alias("place_b"))
    heads = smaller.groupBy("sign", "part").agg(F.max(F.struct("n", "a", "place")).alias("head")).select("sign", "part", "head.*")
    stars = larger.join(heads, ["sign", "part"]).where((F.col("a") != F.col("b")) & _may_reach(least))
    stars = stars.groupBy("b").agg(F.min("a").alias("a"))  # one comparison for each class; in a group most take the same one
    links = written(_near_pairs(stars, sets, least), "spot-stars")
    groups = components(links, "a", "b")

    def grouped(side: DataFrame, c: str) -> DataFrame:
        return side.join(groups.select(F.col("vertex").alias(c), F.col("component").alias(f"group_{c}")), c, "left").withColumn(f"group_{c}", F.coalesce(f"group_{c}", c))

    one, two = grouped(smaller, "a"), grouped(larger, "b")
    apart = one.select("sign", "part", F.col("group_a").alias("g")).unionByName(two.select("sign", "part", F.col("group_b").alias("g")))
    apart = apart.groupBy("sign", "part").agg(F.min("g").alias("x"), F.max("g").alias("y")).where("x < y").select("sign", "part")
    one, two = (side.join(apart, ["sign", "part"], "left_semi") for side in (one, two))
    rest = one.join(two, ["sign", "part"]).where((F.col("group_a") != F.col("group_b")) & (F.col("n") <= F.col("m")) & _may_reach(least)).select("a", "b")
    links = written(links.unionByName(_near_pairs(rest, sets, least)), "spot-links")
    groups = components(links, "a", "b")

    classes = some.groupBy("class").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n_same"))
    classes = classes.join(groups.withColumnRenamed("vertex", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    classes = written(classes, "spot-classes")
    names = classes.groupBy("component").agg(F.min("least_id").alias("group_id"))
    named = written(classes.join(names, "component").select("class", "n_same", "group_id"), "spot-names")
    out = signed.select("doc_id", F.size("signatures").alias("n_signatures"), "class").join(named, "class", "left")
    alone = F.col("n_signatures") == 0
    return out.select("doc_id", F.col("n_signatures").cast("long").alias("n_signatures"), F.when(alone, F.col("doc_id")).otherwise(F.col("group_id")).alias("group_id"), F.coalesce("n_same", F.lit(1)).cast("long").alias("n_same"))


def edited(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside that of its edited text and that of the next document."""
    n, cut = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    given = documents_only(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    first = given.agg(F.min_by("text", F.struct("doc_id", F.md5(F.col("text").cast("binary")))).alias("first_text"))
    first = first.withColumn("plain", plain_words(F.col("first_text"))).withColumn("first_signatures", signatures(F.col("first_text"), F.col("plain"))).drop("plain")
    texts = with_next(docs).crossJoin(F.broadcast(first))  # one row on the right
    texts = texts.withColumns({f"next_{c}": F.coalesce(f"next_{c}", f"first_{c}") for c in ("text", "signatures")})
    changed = F.concat(F.substr(F.col("text"), F.lit(1), n - cut), F.substr(F.col("next_text"), F.lit(1), cut))
    texts = texts.withColumn("edited", changed).withColumn("plain", plain_words(F.col("edited"))).withColumn("signs", signatures(F.col("edited"), F.col("plain")))
    return texts.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint_text(F.col("signatures")).alias("fingerprint"), fingerprint_text(F.col("signs")).alias("edited_fingerprint"),
        likeness(F.col("signatures"), F.col("signs")).alias("near_edited"), likeness(F.col("signatures"), F.col("next_signatures")).alias("near_next"),
        length_partition(F.size("signatures")).alias("length_partition"),
    )
