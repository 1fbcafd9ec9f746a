"""URL rules indexed by their rarest literal token; only the rules that a URL's tokens fetch run their pattern."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The index goes into the plan as one constant up to this many bytes; a larger one is joined by token.
INDEX_BYTES = 1 << 20
#: Parts that a token's URLs are dealt out over in the joined index.
SALTS = 32


@dataclass(frozen=True)
class Rule:
    """Host and path prefix; fits the host and its subdomains, where the path begins with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def host_pattern(self) -> str:
        """Over a host of any characters, line feeds too: the rule's own or one below it."""
        return rf"(?s)\A(?:.*\.)?{re.escape(self.host)}\z"

    @property
    def path_pattern(self) -> str:
        return rf"(?s)\A{re.escape(self.path)}"

    @property
    def literals(self) -> list[str]:
        """Tokens that every URL the rule fits has: host labels, and path words that the rule's path holds to their end."""
        words = re.findall(r"[0-9a-zA-Z]+(?=[^0-9a-zA-Z])", self.path)
        return sorted({f"h:{x}" for x in self.host.split(".") if x} | {f"p:{w}" for w in words})


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    rest = F.when(url.contains("://"), F.substring(url, F.lit(4) + F.instr(url, "://") - 1, F.length(url)))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*(/[^?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lowered, F.lit("")), F.coalesce(path, F.lit(""))


def _tokens(host: Column, path: Column) -> Column:
    labels = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    words = F.transform(F.regexp_extract_all(path, F.lit(r"([0-9a-zA-Z]+)"), 1), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(labels, words))


def _candidates(host: Column, path: Column) -> Column:
    """The tokens under which a URL's rules can stand; the empty one holds rules without a literal."""
    return F.concat(F.array(F.lit("")), _tokens(host, path))


def rule_index(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rows (token, host_pattern, path_pattern, name, verdict): each rule under its rarest literal token in ``urls``.

    Counts of the rules' own tokens over all rows of (host, path), made with map-side aggregation and joined to the rules; ties go
    to the first token by name. Nothing is collected.
    """
    said = [{"id": i, "host_pattern": r.host_pattern, "path_pattern": r.path_pattern, "name": r.name, "verdict": r.verdict, "literals": r.literals or [""]} for i, r in enumerate(rules)]
    kind = "array<struct<id: bigint, host_pattern: string, path_pattern: string, name: string, verdict: string, literals: array<string>>>"
    table = urls.sparkSession.range(1).select(F.explode(F.from_json(F.lit(json.dumps(said)), kind)).alias("r")).select("r.*")
    wanted = table.select("id", F.explode("literals").alias("token"))
    seen = urls.select(F.explode(_tokens(F.col("host"), F.col("path"))).alias("token")).join(wanted.select("token").distinct(), "token", "left_semi")
    counts = seen.groupBy("token").count()
    rarest = wanted.join(counts, "token", "left").groupBy("id").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "token"))["token"].alias("token"))
    return table.drop("literals").join(rarest, "id").drop("id")


def judged(pages: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to ``pages``.

    The longest fitting rule (by characters of host and path; ties by name) decides; without one ``rule`` is null
    and ``verdict`` is ``default``. A null URL, or one without ``://``, has empty parts and fits no rule. Rows keep
    their multiplicity. Columns named host, path, rule or verdict are replaced. No rows or no rules give no verdict but the default.

    Rules of up to INDEX_BYTES make one projection without shuffle: a constant map from token to rules. Beyond it the
    distinct URLs are joined with the rules by token, dealt out over SALTS parts of a token, as most URLs share a
    few, and the verdicts with the rows by URL.
    """
    host, path = url_parts(F.col(f"`{url}`"))
    rows = pages.drop("host", "path", "rule", "verdict").withColumn("host", host).withColumn("path", path)
    named = "host_pattern string, path_pattern string, name string, verdict string"
    size = sum(len(r.host_pattern) + len(r.path_pattern) + len(r.name) + 80 for r in rules)
    if size <= INDEX_BYTES:
        # the rules are few, so their index is too
        index: dict[str, list[dict]] = {}
        for r in rule_index(rows.select("host", "path"), rules).collect() if rules else []:
            index.setdefault(r["token"], []).append({k: r[k] for k in ("host_pattern", "path_pattern", "name", "verdict")})
        kept = F.from_json(F.lit(json.dumps(index)), f"map<string, array<struct<{named.replace(' string', ': string')}>>>")
        fetched = F.flatten(F.filter(F.transform(_candidates(F.col("host"), F.col("path")), lambda t: F.element_at(kept, t)), lambda x: x.isNotNull()))
        fitting = F.filter(fetched, lambda r: F.rlike(F.col("host"), r["host_pattern"]) & F.rlike(F.col("path"), r["path_pattern"]))
        ranked = F.array_sort(F.transform(fitting, lambda r: F.struct((-F.length(r["name"])).alias("n"), r["name"].alias("name"), r["verdict"].alias("verdict"))))
        out = rows.withColumn("_best", F.get(ranked, F.lit(0)))
    else:
        index = rule_index(rows.select("host", "path"), rules).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        parts = rows.select("host", "path").distinct().withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int"))
        fetched = parts.withColumn("token", F.explode(_candidates(F.col("host"), F.col("path")))).join(index, ["token", "salt"])
        fitting = fetched.where(F.rlike(F.col("host"), F.col("host_pattern")) & F.rlike(F.col("path"), F.col("path_pattern")))
        best = fitting.groupBy("host", "path").agg(F.min(F.struct((-F.length("name")).alias("n"), "name", "verdict")).alias("_best"))
        out = rows.join(best, ["host", "path"], "left")
    return out.withColumn("rule", F.col("_best.name")).withColumn("verdict", F.coalesce(F.col("_best.verdict"), F.lit(default))).drop("_best")


#: The query's rules, fixed by its contract.
RULES = [Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"), Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block")]


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for the url of all ``pages``."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judged(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


OP3_SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), cut AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(rest, '\A([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '(?s)\A[^/?#]*(/[^?#]*)', 1), '') AS path
  FROM parts
), fits AS (
  SELECT page_id, host, path,
    CASE WHEN ends_with('.' || host, '.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
         WHEN ends_with('.' || host, '.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
         WHEN ends_with('.' || host, '.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
         WHEN ends_with('.' || host, '.com') AND starts_with(path, '/de/') THEN 'com/de/'
         WHEN ends_with('.' || host, '.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM cut
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM fits
"""
