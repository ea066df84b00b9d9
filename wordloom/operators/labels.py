"""Training lines, label grouping and label <-> column reshapes.

Two data shapes are used:

* array form - one row per text with ``tokens``/``labels`` arrays.  Every
  per-text step (backfill, run merging, pivot to columns, grouping by label)
  is a higher-order-function projection: no shuffle at all.
* long form - ``(seq_id, pos, token, label)``.  Corpus-wide steps (distinct
  terms per label, label vocabulary) aggregate it with map-side partial
  aggregation, so a hot label or term never lands whole in one task.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom import fixed
from wordloom.functions import text as T
from wordloom.operators import batches


def _seq0(n: Column) -> Column:
    """0..n-1, empty when n <= 0 (``sequence(0, -1)`` would count down)."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


# ---------------------------------------------------------------------------
# SEQ-4 parts: SRC-4 / CLN-8 / CLN-9 / RSH-3 / WIN-6 / RSH-4
# ---------------------------------------------------------------------------

def training_fields(line: Column) -> Column:
    """SRC-4 + CLN-8 + CLN-9: lower-case, patch label typos, naive comma split (empty cells kept)."""
    return F.split(T.fix_labels(F.lower(line)), ",", -1)


def training_pairs_array(fields: Column) -> Column:
    """RSH-3: split fields ``term,label,term,label,...`` -> ``array<struct<pos, term, label>>``.

    A trailing term without a label gets label ''.  Pass a column that is
    already materialised (see ``parse_training_lines``) so the split is not
    repeated for every element.
    """
    f = T._c(fields)
    npairs = F.floor((F.size(f) + 1) / 2).cast("int")
    return F.transform(_seq0(npairs), lambda i: F.struct(
        i.alias("pos"), F.get(f, i * 2).alias("term"),
        F.coalesce(F.get(f, i * 2 + 1), F.lit("")).alias("label")))


def keep_rows(df: DataFrame, cond: Column) -> DataFrame:
    """Row selection that the optimizer does not push below staged columns.

    A plain ``where`` on a derived column is pushed down with the derivation
    inlined, so the derivation runs twice.  Exploding a 0/1-element array
    (outer form, so no size filter is inferred and pushed down either)
    selects the same rows after the projection, computing everything once.
    """
    flag = F.posexplode_outer(F.when(cond, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")))
    return df.select("*", flag.alias("_kp", "_keep")).where(F.col("_kp").isNotNull()).drop("_kp", "_keep")


def backfill_labels(pairs: Column, mode: str = "next") -> Column:
    """WIN-6: fill blank labels.

    ``mode="next"``: a blank label takes the next non-blank label to its right
    (the documented intent: a blank marks part of a longer entity).
    ``mode="last"``: every blank takes the line's last non-blank label.
    Labels that stay blank become null.
    """
    n = F.size(pairs)
    if mode == "last":
        last = F.get(F.reverse(F.filter(pairs, lambda p: p["label"] != "")), 0)["label"]
        return T.let(last, lambda lst: F.transform(pairs, lambda p: p.withField(
            "label", F.when(p["label"] != "", p["label"]).otherwise(lst))))
    if mode != "next":
        raise ValueError("mode must be 'next' or 'last'")
    return F.transform(pairs, lambda p, i: p.withField(
        "label", F.when(p["label"] != "", p["label"]).otherwise(
            F.get(F.filter(F.slice(pairs, i + 1, F.greatest(n - i, F.lit(1))),
                           lambda q: q["label"] != ""), 0)["label"])))


def parse_training_lines(df: DataFrame, line_col: str = "line", id_col: str = "line_id",
                         labels: list[str] = fixed.LABELS, mode: str = "next") -> DataFrame:
    """SEQ-4 core: one row per line with ``pairs`` (blank terms dropped) and ``reason``.

    ``reason`` is null for accepted lines; otherwise ``blank_line``,
    ``bad_label`` (a label outside ``labels``) or ``unlabelled_term``.
    """
    dom = F.array(*[F.lit(x) for x in labels])
    # each array is its own column so it is computed once (no inlining into every use)
    staged = (df.select(id_col, line_col, training_fields(F.col(line_col)).alias("_f"))
                .select(id_col, line_col, training_pairs_array(F.col("_f")).alias("_raw"))
                .withColumn("_kept", F.filter(backfill_labels(F.col("_raw"), mode), lambda p: p["term"] != "")))
    bad = F.exists("_raw", lambda p: (p["label"] != "") & ~F.array_contains(dom, p["label"]))
    unl = F.exists("_kept", lambda p: p["label"].isNull())
    reason = (F.when(F.trim(F.coalesce(F.col(line_col), F.lit(""))) == "", "blank_line")
               .when(F.size("_kept") == 0, "blank_line")
               .when(bad, "bad_label")
               .when(unl, "unlabelled_term"))
    return staged.select(id_col, line_col, F.col("_kept").alias("pairs"), reason.alias("reason"))


def training_pairs(parsed: DataFrame, id_col: str = "line_id") -> DataFrame:
    """Long form ``(line_id, pos, term, label)`` of the accepted lines."""
    pairs = F.when(F.col("reason").isNull(), F.col("pairs"))
    ex = parsed.select(id_col, F.posexplode_outer(pairs).alias("_p", "_e")).where(F.col("_p").isNotNull())
    return ex.select(id_col, "_e.*")


def training_rejects(parsed: DataFrame) -> DataFrame:
    """RSH-4 side output: rejected lines with their reason."""
    return keep_rows(parsed, F.col("reason").isNotNull())


def training_xml(parsed: DataFrame) -> Column:
    """SNK-1 body: ``<TokenSequence><label>term</label> ...</TokenSequence>`` (term XML-escaped)."""
    def esc(c):
        return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                         F.lit(">"), F.lit("&gt;"))
    body = F.array_join(F.transform("pairs", lambda p: F.concat(
        F.lit("<"), p["label"], F.lit(">"), esc(p["term"]), F.lit("</"), p["label"], F.lit("> "))), "")
    return F.concat(F.lit("<TokenSequence>"), body, F.lit("</TokenSequence>"))


def gazetteer_mine(pairs: DataFrame) -> DataFrame:
    """AGG-2: ``(label, term, n)`` distinct terms per label with their counts."""
    return pairs.groupBy("label", "term").agg(F.count(F.lit(1)).alias("n"))


def label_vocabulary(pairs: DataFrame) -> DataFrame:
    """AGG-3: distinct labels with line and term counts."""
    return pairs.groupBy("label").agg(F.count(F.lit(1)).alias("n_terms"),
                                      F.countDistinct("line_id").alias("n_lines"))


# ---------------------------------------------------------------------------
# Array-form operators on (tokens, labels)
# ---------------------------------------------------------------------------

def group_tags(tokens, labels) -> Column:
    """AGG-1: label -> joined tokens in first-appearance label order.

    Returns ``array<struct<label, first_pos, text>>``; text is stripped of blanks,
    commas and semicolons at both ends.
    """
    tk, lb = T._c(tokens), T._c(labels)
    z = F.arrays_zip(tk.alias("t"), lb.alias("l"))
    return T.let(z, lambda zz: F.transform(F.array_distinct(lb), lambda l: F.struct(
        l.alias("label"),
        (F.array_position(lb, l) - 1).cast("int").alias("first_pos"),
        F.regexp_replace(F.array_join(F.transform(F.filter(zz, lambda e: e["l"] == l), lambda e: e["t"]), " "),
                         r"^[ ,;]+|[ ,;]+$", "").alias("text"))))


def merge_object_runs(tokens, labels, run_label: str = "object") -> Column:
    """WIN-2: consecutive ``run_label`` tokens become one term.

    Returns ``array<struct<label, term, pos>>`` with ``pos`` the first token's position.
    """
    tk, lb = T._c(tokens), T._c(labels)
    n = F.size(tk)
    starts = F.filter(_seq0(n), lambda i: ~((i > 0) & (F.get(lb, i) == run_label)
                                           & (F.get(lb, i - 1) == run_label)))
    return T.let(starts, lambda st: F.transform(st, lambda s, k: F.struct(
        F.get(lb, s).alias("label"),
        F.array_join(F.slice(tk, s + 1, F.coalesce(F.get(st, k + 1), n) - s), " ").alias("term"),
        s.alias("pos"))))


def label_runs(tokens, labels, fixes=fixed.PREDICTED_LABEL_FIXES) -> Column:
    """WIN-2 + CLN-9 on predicted labels: merged runs with patched labels."""
    runs = merge_object_runs(tokens, labels)
    return F.transform(runs, lambda r: r.withField("label", T.fix_labels(r["label"], fixes)))


def second_objects(runs) -> Column:
    """WIN-3: the first object run keeps ``object``; later ones become ``object2``."""
    runs = T._c(runs)
    first_obj = F.get(F.filter(runs, lambda r: r["label"] == "object"), 0)["pos"]
    return T.let(first_obj, lambda fo: F.transform(runs, lambda r: r.withField(
        "label", F.when((r["label"] == "object") & (r["pos"] > fo), F.lit(fixed.OBJECT2))
                  .otherwise(r["label"]))))


def with_label_columns(df: DataFrame, tokens: str = "tokens", labels: str = "labels",
                       columns: list[str] = fixed.LABELS, keep=None,
                       fixes=fixed.PREDICTED_LABEL_FIXES, clash_prefix: str = "ent_") -> DataFrame:
    """RSH-1 (with WIN-2, WIN-3): one string column per label plus ``object2``.

    Object runs are merged first; the first object run fills ``object``,
    later ones fill ``object2``.  Several terms of one label join with a
    blank; labels outside ``columns`` are dropped; absent labels give ''.
    Texts are worked on by Arrow batch (`batches.label_columns`), as `label_runs`
    and `second_objects` have it.  A label column whose name is already taken
    by a kept column (the work order's own ``description``) gets ``clash_prefix``.
    """
    keep = [c for c in df.columns if c not in (tokens, labels)] if keep is None else list(keep)
    columns, fixes = list(columns), list(fixes)
    names = {c: (clash_prefix + c if c in keep else c) for c in columns + [fixed.OBJECT2]}

    def pivoted(tk: pa.Array, lb: pa.Array) -> pa.Array:
        return batches.label_columns(tk, lb, columns, fixes, "object", fixed.OBJECT2)

    kind = ", ".join(f"`{c}` string" for c in columns + [fixed.OBJECT2])
    texts = [F.col(c).cast("array<string>") for c in (tokens, labels)]
    staged = df.select(*keep, F.arrow_udf(pivoted, f"struct<{kind.replace(' string', ': string')}>")(*texts).alias("_cols"))
    return staged.select(*keep, *[F.col("_cols").getField(c).alias(names[c]) for c in columns + [fixed.OBJECT2]])


def columns_to_entities(df: DataFrame, id_cols, types: list[str] = fixed.ENTITY_TYPES,
                        type_col: str = "type", value_col: str = "entity") -> DataFrame:
    """RSH-2: melt the entity columns to ``(ids.., type, entity, type_ord)``; blanks dropped, values stripped."""
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    stacked = df.select(*ids, F.explode(F.array(*[
        F.struct(F.lit(t).alias(type_col), F.lit(i).alias("type_ord"), F.col(t).cast("string").alias(value_col))
        for i, t in enumerate(types)])).alias("_e")).select(*ids, "_e.*")
    stripped = F.regexp_replace(F.col(value_col), r"^\s+|\s+$", "")
    return stacked.withColumn(value_col, stripped).where(F.col(value_col) != "")


def first_seen(df: DataFrame, key_cols, order_cols, keep_cols) -> DataFrame:
    """WIN-4: per key keep the row that is first by ``order_cols``.

    Expressed as ``groupBy(key).agg(min(struct(order.., keep..)))`` so map-side
    partial aggregation collapses a hot key before the shuffle.
    """
    keys = [key_cols] if isinstance(key_cols, str) else list(key_cols)
    order = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    keep = [keep_cols] if isinstance(keep_cols, str) else list(keep_cols)
    m = F.min(F.struct(*[F.col(c) for c in order + keep])).alias("_m")
    return df.groupBy(*keys).agg(m).select(*keys, *[F.col(f"_m.{c}").alias(c) for c in order + keep])


def last_wins(df: DataFrame, key_cols, seq_col: str, keep_cols=()) -> DataFrame:
    """WIN-5: per key keep ``seq_col`` and the values of the row with the greatest ``seq_col``."""
    keys = [key_cols] if isinstance(key_cols, str) else list(key_cols)
    keep = [c for c in ([keep_cols] if isinstance(keep_cols, str) else list(keep_cols)) if c != seq_col]
    m = F.max(F.struct(F.col(seq_col), *[F.col(c) for c in keep])).alias("_m")
    return df.groupBy(*keys).agg(m).select(*keys, *[F.col(f"_m.{c}").alias(c) for c in [seq_col] + keep])
