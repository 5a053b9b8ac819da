"""URL filters: explicit host/path rules first, then a path-template tree.

1. Per host, the tree grows by one path segment a level, for as many levels as the longest
   path has.  A segment with a digit is a wildcard.  Where a node has more than ``max_children``
   other children, those with fewer than ``min_rows`` rows and ``min_labelled`` labels are
   folded into the wildcard; well supported children stay literal.
2. Templates of a host that differ in their first literal segment only are siblings.  Those whose
   labelled block rate does not differ from their pool's by a z test are merged.
3. A template's purity is its share of blocked labels, smoothed by ``strength`` labels at the
   template's rate over all hosts, itself ``(blocked + 1) / (labelled + 2)``.  So a template
   without labels on its host inherits what is known of it elsewhere, and a few labels of the host's
   own outweigh that.  Purity of ``purity`` and more rejects it.

Labels are the verdicts of the rules, or a label column.  Only built-in expressions,
aggregates and equi-joins.  Pages collapse to distinct paths by map-side aggregation; keys that many
rows share (a hot host's branch, a repeated URL) are joined apart (``join_counted``).

Defined results
---------------
* null URL, or one without ``://``: empty host and path; no rule; verdict by the empty template of
  the empty host.
* empty path: no rule with a path fits, the template is ``/``.
* empty segments (``//``, a slash at the end) do not count; a segment ``*`` is a wildcard.
* very long URLs: whole.  From segment ``ALONE`` on, a branch that holds a single path ends in ``**``: no
  other path of the host can be compared with it.  So a stray path of many segments costs no level each.
* repeated rows: each is returned; ids may repeat or be null.  Ties of purity reject.
* empty table: empty result.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import join_counted, scope, table

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with the rule's.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The segment from which a branch of a single path ends.
ALONE = 8


def url_parts(df: DataFrame, url: str) -> DataFrame:
    """``df`` with ``host`` and ``path``."""
    rest = F.expr(f"if(coalesce(instr(`{url}`, '://'), 0) > 0, substring(`{url}`, instr(`{url}`, '://') + 3), '')")
    out = df.withColumn("_rest", rest).withColumn("_host", F.regexp_extract("_rest", r"^([^/?#]*)", 1))
    path = F.expr("regexp_extract(substring(_rest, length(_host) + 1), '^([^?#]*)', 1)")
    return out.withColumn("path", path).withColumn("host", F.translate("_host", _UPPER, _LOWER)).drop("_rest", "_host")


def _fits(host: str, path: str) -> Column:
    return ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)


def matched_rule(rules=RULES) -> tuple[Column, Column]:
    """(rule text, rule verdict) of the longest fitting rule; a decision list, so meant for up to a few hundred rules."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1]), len(r[2]))):
        hit = _fits(h, p)
        text, verdict = F.when(hit, F.lit(h + p)).otherwise(text), F.when(hit, F.lit(v)).otherwise(verdict)
    return text, verdict


def _grown(paths: DataFrame, max_children: int, min_rows: int, min_labelled: int) -> DataFrame:
    """``paths`` (host, pk, c, nb, n) with the template ``tpl`` of each."""
    depth = paths.agg(F.max(F.size(F.split("pk", "/")))).first()[0] or 0
    state = paths.withColumn("tpl", F.lit("")).withColumn("open", F.col("pk") != "")
    for i in range(depth):
        if i >= ALONE:
            lone = state.filter("open").groupBy("host", "tpl").agg(F.count("*").alias("k"), F.min("pk").alias("pk")).filter("k = 1").select("host", "pk", F.lit(True).alias("lone"))
            state = state.join(lone, ["host", "pk"], "left").withColumn("tpl", F.when(F.col("lone"), F.concat("tpl", F.lit("/**"))).otherwise(F.col("tpl")))
            state = table(state.withColumn("open", F.col("open") & F.col("lone").isNull()).drop("lone"))
        segment = F.get(F.split("pk", "/"), F.lit(i))
        state = state.withColumn("seg", F.when(F.col("open"), F.when(segment.rlike("[0-9]"), "*").otherwise(segment)))
        here = state.filter("seg is not null and seg <> '*'")
        kids = here.groupBy("host", "tpl", "seg").agg(F.sum("c").alias("c"), F.sum("n").alias("n"), F.count("*").alias("k"))
        wide = kids.groupBy("host", "tpl").agg(F.count("*").alias("m")).filter(F.col("m") > max_children)
        if not wide.isEmpty():
            kids, wide = table(kids), table(wide)
            few = (F.col("c") < min_rows) & (F.col("n") < min_labelled)
            fold = join_counted(kids, wide, ["host", "tpl"], "m").filter(few).select("host", "tpl", "seg", F.lit("*").alias("to"))
            named = kids.join(fold, ["host", "tpl", "seg"], "left").select("host", "tpl", "seg", F.coalesce("to", "seg").alias("to"), "k")
            here = join_counted(here, table(named), ["host", "tpl", "seg"], "k")
            state = here.unionByName(state.filter("seg is null or seg = '*'").withColumn("to", F.col("seg"))).withColumn("seg", F.col("to")).drop("to")
            state = table(state)
        state = state.withColumn("tpl", F.concat("tpl", F.coalesce(F.concat(F.lit("/"), "seg"), F.lit("")))).drop("seg")
        state = state.withColumn("open", F.col("open") & (F.size(F.split("pk", "/")) > i + 1))
    return table(state.select("host", "pk", "c", "nb", "n", F.when(F.col("tpl") == "", "/").otherwise(F.col("tpl")).alias("tpl")))


def _judged(leaves: DataFrame, min_labelled: int, z: float, strength: int, purity: float) -> DataFrame:
    """``host, tpl, k, verdict``: the templates of ``leaves``, ``k`` paths each, and what the tree says of them."""
    tpl = leaves.groupBy("host", "tpl").agg(F.sum("nb").alias("nb"), F.sum("n").alias("n"), F.count("*").alias("k"))
    parts = F.split(F.expr("substring(tpl, 2)"), "/")
    first = F.array_position(F.transform(parts, lambda s: ~s.isin("", "*", "**")), True)
    family = F.when(first > 0, F.array_join(F.transform(parts, lambda s, i: F.when(i + 1 == first, "*").otherwise(s)), "/")).otherwise(F.col("tpl"))
    tpl = table(tpl.withColumn("family", family))
    known = F.col("n") >= min_labelled
    pool = tpl.groupBy("host", "family").agg(F.sum(F.when(known, F.col("nb"))).alias("fb"), F.sum(F.when(known, F.col("n"))).alias("fn"), F.count("*").alias("m"))
    tpl = join_counted(tpl, pool, ["host", "family"], "m").withColumn("rate", F.col("fb") / F.col("fn"))
    near = (F.col("nb") - F.col("n") * F.col("rate")) ** 2 <= z * z * F.col("n") * F.col("rate") * (1 - F.col("rate")) + 1e-9
    tpl = table(tpl.withColumn("near", F.coalesce(known & near, F.lit(False))).drop("fb", "fn", "rate"))
    merged = tpl.groupBy("host", "family").agg(F.sum(F.when(F.col("near"), F.col("nb"))).alias("mb"), F.sum(F.when(F.col("near"), F.col("n"))).alias("mn"), F.count("*").alias("m"))
    everywhere = tpl.groupBy("tpl").agg(((F.sum("nb") + 1) / (F.sum("n") + 2)).alias("prior"), F.count("*").alias("m"))
    tpl = join_counted(join_counted(tpl, merged, ["host", "family"], "m"), everywhere, ["tpl"], "m")
    b, n = F.when(F.col("near"), F.col("mb")).otherwise(F.col("nb")), F.when(F.col("near"), F.col("mn")).otherwise(F.col("n"))
    bad = b + strength * F.col("prior") >= purity * (n + strength) - 1e-9
    return table(tpl.select("host", "tpl", "k", F.when(bad, "block").otherwise("allow").alias("verdict")))


def url_filters(df: DataFrame, url: str = "url", keep: tuple[str, ...] = ("page_id",), rules=RULES, label: str | None = None, max_children: int = 20,
                min_rows: int = 20, min_labelled: int = 3, z: float = 1.96, strength: int = 2, purity: float = 0.8) -> DataFrame:
    """``keep``, ``host``, ``path``, ``rule``, ``template`` and ``verdict`` of every row.

    ``label`` names a column with ``allow``/``block``/null per row that joins the
    rules' verdicts as labels where no rule fits.
    """
    with scope(df.sparkSession) as kept:
        rows = url_parts(df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(url).alias("u"),
                                   (F.col(label) if label else F.lit(None).cast("string")).alias("y")), "u").drop("u")
        text, verdict = matched_rule(rules)
        rows = rows.withColumn("rule", text).withColumn("rv", verdict).withColumn("y", F.coalesce("rv", "y"))
        rows = table(rows.withColumn("pk", F.expr("array_join(filter(split(path, '/', -1), s -> s != ''), '/')")))
        paths = table(rows.groupBy("host", "pk").agg(F.count("*").alias("c"), F.count(F.when(F.col("y") == "block", 1)).alias("nb"), F.count("y").alias("n")))
        leaves = _grown(paths, max_children, min_rows, min_labelled)
        judged = _judged(leaves, min_labelled, z, strength, purity)
        leaves = table(join_counted(leaves.select("host", "pk", "c", "tpl"), judged, ["host", "tpl"], "k"))
        out = join_counted(rows, leaves, ["host", "pk"], "c")
        out = out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "host", "path", "rule", F.col("tpl").alias("template"),
                         F.coalesce("rv", "verdict").alias("verdict"))
        kept.append(out)
    return out
