"""Names that mean the same: normal forms, alias edges, and the closure of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import cosine, doubles
from ..functions.vectors import let
from ..plans import views as V
from ..registry import query
from ..session import cut, table

# Letters with marks and the letters that they count as.
MARKED, PLAIN = "àâäáãåçèéêëìíîïñòóôöõùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
#: Words that can be names.
NAME = "^[a-zà-ÿ]{5,}$"


def normal(name) -> Column:
    return F.translate(F.lower(name), MARKED, PLAIN)


def closure(names: DataFrame, edges: DataFrame) -> DataFrame:
    """name and label (the least name reachable) of all ``names``, by ``edges`` (a, b). In each round a name takes the least label
    among its neighbours' and its own, and then the label of that label; the rounds end when no label falls."""
    both = cut(edges.union(edges.select("b", "a")).filter("a <> b").distinct())
    at = cut(names.select("name", F.col("name").alias("label")))
    while True:
        near = both.join(at, F.col("b") == F.col("name")).groupBy("a").agg(F.min("label").alias("near"))
        low = at.join(near, F.col("name") == F.col("a"), "left").select("name", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        up = at.select(F.col("name").alias("_name"), F.col("label").alias("_label"))
        new = cut(low.join(up, F.col("label") == F.col("_name"), "left").select("name", "was", F.least("label", "_label").alias("label")))
        at = new.select("name", "label")
        if new.filter("label < was").isEmpty():
            return at


def alias_edges(names: DataFrame) -> DataFrame:
    """Names of one normal form, each with the least of them, and plurals with their singular."""
    forms = names.select("name", normal(F.col("name")).alias("form"))
    least = forms.groupBy("form").agg(F.min("name").alias("b"))
    same = forms.join(least, "form").select(F.col("name").alias("a"), "b")
    plural = names.filter(F.col("name").endswith("s")).select(F.col("name").alias("a"), F.expr("left(name, length(name) - 1)").alias("b"))
    return same.union(plural.join(names.select(F.col("name").alias("b")), "b", "left_semi").select("a", "b")).filter("a <> b")


_REACH = f"""WITH RECURSIVE n AS MATERIALIZED (SELECT DISTINCT term AS name, translate(term, '{MARKED}', '{PLAIN}') AS form FROM postings WHERE regexp_full_match(term, '[a-zà-ÿ]{{5,}}')),
one AS (SELECT a.name AS a, b.b FROM n a JOIN (SELECT form, min(name) AS b FROM n GROUP BY form) b USING (form) UNION SELECT a.name, b.name FROM n a JOIN n b ON b.name || 's' = a.name),
e AS MATERIALIZED (SELECT a, b FROM one WHERE a <> b UNION SELECT b, a FROM one WHERE a <> b),
reach(a, b) AS (SELECT DISTINCT a, a FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
c AS (SELECT a AS name, min(b) AS label FROM reach GROUP BY a)
SELECT label AS name, string_agg(name, '|' ORDER BY name) AS aliases, count(*) AS n FROM c GROUP BY label"""


@query("gr04_aliases", _REACH, "chunks postings")
def gr04_aliases(spark, d):
    """GR04: names of the texts that differ in marks or number only, joined to one name each with its sorted aliases."""
    names = V.terms(spark, d).select(F.col("term").alias("name")).filter(F.col("name").rlike(NAME))
    at = closure(names, alias_edges(names))
    groups = at.groupBy(F.col("label").alias("name")).agg(F.array_join(F.array_sort(F.collect_list("name")), "|").alias("aliases"), F.count("*").alias("n"))
    return groups.filter("n > 1")


@query("rt33_cosine", "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), r AS (SELECT vec_id, v, list_min(v) AS lo, coalesce(nullif((list_max(v) - list_min(v)) / 255.0::DOUBLE, 0), 1) AS step FROM v), q AS (SELECT vec_id, v, step, list_transform(v, lambda x: lo + step * floor((x - lo) / step + 0.500001::DOUBLE)) AS back FROM r) SELECT vec_id, round(list_cosine_similarity(v, back), 6) AS score, list_max(list_transform(range(1, len(v) + 1), lambda i: abs(v[i] - back[i]))) <= step * 0.500002::DOUBLE AS close FROM q")
def rt33_cosine(spark, d):
    """RT33: each vector from one byte a dimension back to numbers: its cosine with what it was, and whether every entry is
    within half a step."""
    v = table(spark, d, "embeddings").select("vec_id", doubles(F.col("embedding")).alias("v"))
    step = F.coalesce(F.nullif((F.array_max("v") - F.array_min("v")) / 255.0, F.lit(0.0)), F.lit(1.0))
    r = v.select("vec_id", "v", F.array_min("v").alias("lo"), step.alias("step"))
    back = F.transform("v", lambda x: F.col("lo") + F.col("step") * F.floor((x - F.col("lo")) / F.col("step") + 0.500001))
    told = let(back, lambda b: F.struct(F.round(cosine(F.col("v"), b), 6).alias("score"), (F.array_max(F.zip_with("v", b, lambda x, y: F.abs(x - y))) <= F.col("step") * 0.500002).alias("close")))
    return r.select("vec_id", told.alias("t")).select("vec_id", "t.score", "t.close")
