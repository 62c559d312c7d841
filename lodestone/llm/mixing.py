"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source starts with the same expected number of copies,
target / size of the source. The whole part is given; the fractions are
rounded by pivotal steps: two fractional documents meet, word mass moves from
one to the other with odds that keep both expectations, and at least one of
them becomes integral. Mass is counted in words, so each step keeps the
source's expected words exactly. Documents are dealt into buckets of about
``FANOUT`` by a hash; each bucket leaves one fractional document, and hands it
on with every eighth by size, undrawn; these meet again level by level. In a
source's last bucket (the only one of a small source) the document left over
is not drawn: one or two documents at a time change sides as long as that
brings the source's words nearer to its target.

Rows that agree in source, id and size are one class: pivotal steps among
equals leave all but one of them integral whatever the draws, so a class of c
rows with fraction p gives floor(c p) copies, and the rest of its mass enters
the tree as one document. However many rows repeat, a bucket stays small.

The draws are hashes of the two documents met, so reruns agree.

Cases: a null source is a source of its own, after all others; a null or
empty text has size 0 and takes 0 words; repeated rows are rows of their own;
an empty table gives an empty result; extra columns ride along in ``mix``,
whatever their names: they travel in one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import SPACE, cut, quoted

FANOUT = 64
#: Weights of the sources in code-point order, repeating; share of all words; cap as a multiple of a source's size.
WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2.0


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda x: x != "")).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, cap=CAP) -> DataFrame:
    """sizes(source, size) -> (source, rank, n, source_size, target). One row per source, so the one-partition windows are over sources, never documents.

    Resharing the excess by weight until none is above its cap ends at
    min(cap, level * weight) with one level; sources are filled in the order
    of cap / weight, and the level is that of the first one left unfilled.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    by_name = W.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), "source")
    w = F.array(*[F.lit(float(x)) for x in weights])
    s = s.withColumn("rank", F.row_number().over(by_name)).withColumn("w", F.element_at(w, ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", cap * F.col("source_size"))
    every = W.partitionBy(F.lit(0))
    filled = every.orderBy(F.col("cap") / F.col("w"), "rank").rowsBetween(W.unboundedPreceding, -1)
    rest = every.orderBy(F.col("cap") / F.col("w"), "rank").rowsBetween(W.currentRow, W.unboundedFollowing)
    s = s.withColumn("total", share * F.sum("source_size").over(every))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(filled), F.lit(0.0))) / F.sum("w").over(rest))
    fill = F.col("cap") / F.col("w")
    first = F.min(F.when(F.col("level") <= fill, F.struct(fill.alias("fill"), "rank", "level"))).over(every)
    s = s.withColumn("first", first).withColumn("level", F.col("first.level"))
    target = F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("w")), F.col("cap"))
    return s.select("source", "rank", "n", "source_size", target.alias("target"))


def _draw(level: int) -> str:
    return f"(pmod(xxhash64(a.c.h, x.h, {level}), 9007199254740992L) / 9007199254740992.0D)"


_DOC = "struct<h: bigint, uid: bigint, size: double, p: double>"
_DONE = "struct<uid: bigint, up: int>"


def _fold(level: int) -> Column:
    """Fold one bucket's documents (array ``docs``): (done, the one that stays fractional)."""
    up1 = "a.c.size * (1 - a.c.p)"  # words until the carried one is whole
    dn1 = "a.c.size * a.c.p"
    up2 = "x.size * (1 - x.p)"
    dn2 = "x.size * x.p"
    rise = f"least({up1}, {dn2})"
    fall = f"least({dn1}, {up2})"
    done = lambda who, up: f"concat(a.done, array(named_struct('uid', {who}.uid, 'up', {up})))"
    keep = lambda who, p: f"named_struct('h', {who}.h, 'uid', {who}.uid, 'size', {who}.size, 'p', {p})"
    state = lambda c, d: f"named_struct('c', {c}, 'done', {d})"
    step = f"""(a, x) -> case when a.c is null then {state('x', 'a.done')}
      when {_draw(level)} * ({rise} + {fall}) < {fall} then
        case when {up1} <= {dn2} then {state(keep('x', f'greatest(0.0D, x.p - {up1} / x.size)'), done('a.c', 1))}
             else {state(keep('a.c', f'least(1.0D, a.c.p + {dn2} / a.c.size)'), done('x', 0))} end
      else
        case when {dn1} <= {up2} then {state(keep('x', f'least(1.0D, x.p + {dn1} / x.size)'), done('a.c', 0))}
             else {state(keep('a.c', f'greatest(0.0D, a.c.p - {up2} / a.c.size)'), done('x', 1))} end
      end"""
    return F.expr(f"aggregate(docs, named_struct('c', cast(null as {_DOC}), 'done', cast(array() as array<{_DONE}>)), {step})")


#: So many buckets of one level meet in one of the next; rounds of the settling of a part's last bucket.
SHRINK, ROUNDS = 8, 6


def _settle() -> Column:
    """(uid, up) of a part's last bucket, folded as ``r``: what its fractional document leaves open is closed in a few rounds, each of which turns the one or
    two documents that bring the words nearest to the target."""
    turn = lambda i: f"if(a.ups[{i}] = 1, -docs[{i}].size, docs[{i}].size)"
    moves = f"flatten(transform(sequence(0, size(docs) - 1), i -> transform(sequence(i, size(docs) - 1), j -> named_struct('left', abs(a.need - {turn('i')} - if(i = j, 0.0D, {turn('j')})), 'i', i, 'j', j))))"
    turned = f"named_struct('need', a.need - {turn('m.i')} - if(m.i = m.j, 0.0D, {turn('m.j')}), 'ups', transform(a.ups, (u, i) -> if(i = m.i or i = m.j, 1 - u, u)))"
    step = f"(a, k) -> transform(array(array_min({moves})), m -> if(m.left < abs(a.need) - 1e-9, {turned}, a))[0]"
    start = "named_struct('need', coalesce(r.c.size * r.c.p, 0.0D), 'ups', transform(docs, x -> cast(exists(r.done, y -> y.uid = x.uid and y.up = 1) as int)))"
    return F.expr(f"aggregate(sequence(1, {ROUNDS}), {start}, {step}, a -> transform(docs, (x, i) -> named_struct('uid', x.uid, 'up', a.ups[i])))")


def round_copies(rows: DataFrame, n_max: int, fanout: int = FANOUT) -> DataFrame:
    """rows(part, n, h, uid, size, p) with 0 < p < 1 and size > 0 -> (uid, up). n_max: rows of the largest part.

    A bucket hands on its fractional document and every eighth by size, which
    are not drawn there, so documents of all sizes are in the last one.
    """
    wide = F.greatest(F.lit(1), F.ceil(F.col("n") / fanout)).cast("long")
    now = rows.withColumn("wide", wide).withColumn("bucket", F.pmod("h", "wide"))
    out, width = None, max(1, -(-n_max // fanout))
    for level in range(100):
        # The largest come first: a document is carried until others have filled it, so what is handed on is small.
        by_size = F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("less"), "h", "uid", "size", "p")))
        plain = F.transform(by_size, lambda x: F.struct(x["h"].alias("h"), x["uid"].alias("uid"), x["size"].alias("size"), x["p"].alias("p")))
        tree = now.groupBy("part", "wide", "bucket").agg(plain.alias("plain"))
        waits = lambda i: (F.col("wide") > 1) & (i % SHRINK == SHRINK - 1)
        tree = tree.select("part", "wide", "bucket", F.filter("plain", lambda x, i: ~waits(i)).alias("docs"), F.filter("plain", lambda x, i: waits(i)).alias("rest")).withColumn("r", _fold(level))
        last = F.when(F.col("wide") == 1, _settle())
        tree = cut(tree.select("part", "wide", "bucket", F.coalesce(last, "r.done").alias("done"), F.concat(F.filter(F.array("r.c"), lambda c: c.isNotNull()), "rest").alias("left")))
        done = tree.select(F.inline("done"))
        out = done if out is None else out.unionByName(done)
        if width == 1:
            break
        now = tree.where("wide > 1").select("part", F.ceil(F.col("wide") / SHRINK).cast("long").alias("wide"), F.floor(F.col("bucket") / SHRINK).cast("long").alias("bucket"), F.inline("left"))
        width = -(-width // SHRINK)
    return out


def copies(docs: DataFrame, source: str = "source", text: str = "text", id_col: str = "doc_id", **how) -> DataFrame:
    """(mix_uid, id, size, source_size, target, taken, copies): one row for each input row."""
    base = cut(docs.select(F.monotonically_increasing_id().alias("mix_uid"), id_col, F.col(source).alias("source"), n_words(F.col(text)).alias("size")))
    return _copies(base, id_col, **how)


def _copies(base: DataFrame, id_col: str, **how) -> DataFrame:
    s = cut(targets(base, **how))
    rows = base.join(s, base["source"].eqNullSafe(s["source"])).drop(s["source"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("rate", rate).withColumn("whole", F.floor(F.col("rate") + 1e-9)).withColumn("p", F.col("rate") - F.col("whole"))
    some = rows.where((F.col("p") > 1e-9) & (F.col("size") > 0)).withColumn("h", F.xxhash64(id_col, "size"))
    key = ["rank", "h", "size"]
    classes = some.groupBy(*key).agg(F.first("n").alias("n"), F.first("p").alias("p1"), F.count("*").alias("c"), F.min("mix_uid").alias("uid"))
    classes = cut(classes.withColumn("sure", F.floor(F.col("c") * F.col("p1") + 1e-9)).withColumn("p", F.greatest(F.lit(0.0), F.col("c") * F.col("p1") - F.col("sure"))))
    n_max = s.agg(F.max("n")).first()[0] or 0
    drawn = round_copies(classes.where("p > 1e-9").select(F.col("rank").alias("part"), "n", "h", "uid", F.col("size").cast("double").alias("size"), "p"), n_max)
    got = cut(classes.join(drawn, "uid", "left").select(*key, "uid", "c", (F.col("sure") + F.coalesce("up", F.lit(0))).alias("ups")))
    alone = got.where("c = 1").select("uid", "ups")
    ups = alone.unionByName(_among_equals(some.select("mix_uid", *key), got.where("c > 1").select(*key, "ups")))
    out = rows.join(ups, rows.mix_uid == ups.uid, "left")
    n = (F.col("whole") + F.coalesce("ups", F.lit(0))).cast("long")
    return out.select("mix_uid", id_col, "size", "source_size", "target", (n * F.col("size")).alias("taken"), n.alias("copies"))


def _among_equals(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(uid, ups): of each class of equal rows the first ``ups`` get a copy. Rows are numbered within (class, stored partition), after the
    partitions' counts, so no class gathers in a task."""
    key = ["rank", "h", "size"]
    mine = cut(rows.join(classes, key).withColumn("place", F.shiftright("mix_uid", 33)))
    counts = mine.groupBy(*key, "place").agg(F.count("*").alias("k"))
    before = F.coalesce(F.sum("k").over(W.partitionBy(*key).orderBy("place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = cut(counts.select(*key, "place", before.alias("before")))
    order = F.row_number().over(W.partitionBy(*key, "place").orderBy("mix_uid"))
    numbered = mine.withColumn("r", order).join(offsets, [*key, "place"])
    return numbered.select(F.col("mix_uid").alias("uid"), (F.col("before") + F.col("r") <= F.col("ups")).cast("long").alias("ups"))


def op5_mix_sources(spark, sf_dir):
    """doc_id, size, source_size, target, taken: one row for each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return copies(docs).select("doc_id", "size", "source_size", "target", "taken")


def mix(docs: DataFrame) -> DataFrame:
    """The documents themselves, each repeated as often as the mix takes it; one without words as often as the whole part of its source's rate. ``docs`` is a stored table: rows are named by their place in it."""
    held = docs.select(F.monotonically_increasing_id().alias("mix_uid"), F.struct(*[quoted(c) for c in docs.columns]).alias("doc"))
    base = cut(held.select("mix_uid", "doc.doc_id", "doc.source", n_words(F.col("doc.text")).alias("size")))
    n = _copies(base, "doc_id").select("mix_uid", "copies")
    return held.join(n, "mix_uid").select("doc", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("doc.*")
