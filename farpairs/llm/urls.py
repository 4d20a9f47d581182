"""9. URL filters with redirect equivalence.

Rules (action, host, path) fit a host and its subdomains where the url's path
starts with the rule's; the longest rule (host and path) wins. Pages that redirect
to each other or name the same canonical link are aliases: components of the
undirected graph of such edges. A page without a rule of its own takes its
component's verdict: allow if any alias is allowed by a rule, else block if any is
blocked, else allow. A page's own rule always stands.

Edges are taken from the page: <link rel=canonical>, <meta http-equiv=refresh> and
og:url; extra edges (from crawl logs) may be given as a table (src, dst) of urls.
A node is the url without scheme, fragment and trailing slash, host lower-cased.

Defined results: a null url or one without "://" has an empty host and path, no rule
and no aliases, and is allowed; null html has no edges; repeated rows get the same
verdict; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farpairs.llm.common import connected_components, materialize
from farpairs.tables import table

#: (action, host, path)
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Most rules that are held as a literal in the plan; more are joined.
MAX_RULES = 200

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINKS = [
    r"""(?i)<link\s[^>]*?rel\s*=\s*["']?canonical["']?[^>]*?href\s*=\s*["']?([^"'\s>]+)""",
    r"""(?i)<link\s[^>]*?href\s*=\s*["']?([^"'\s>]+)["']?[^>]*?rel\s*=\s*["']?canonical""",
    r"""(?i)<meta\s[^>]*?http-equiv\s*=\s*["']?refresh["']?[^>]*?url\s*=\s*["']?([^"'\s>]+)""",
    r"""(?i)<meta\s[^>]*?property\s*=\s*["']?og:url["']?[^>]*?content\s*=\s*["']?([^"'\s>]+)""",
]


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def node(url: Column) -> Column:
    """Host, path and query; null without "://" or host."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(host(url) != "", F.concat(host(url), F.regexp_replace(rest, "/$", "")))


_WON = "struct<n:int,allow:int,rule:string,action:string>"


def winning(host_col: Column, path_col: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as struct (n, rule, action), else null. Ties: allow first."""
    fits = [
        F.when(
            ((host_col == h) | host_col.endswith(f".{h}")) & path_col.startswith(p),
            F.struct(F.lit(len(h + p)).alias("n"), F.lit(int(a == "allow")).alias("allow"), F.lit(h + p).alias("rule"), F.lit(a).alias("action")),
        )
        for a, h, p in rules
    ]
    return F.greatest(*fits) if len(fits) > 1 else fits[0] if fits else F.lit(None).cast(_WON)


def won_by(rows: DataFrame, rules: list[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """``rows`` (host, path, ...) with ``won``, the longest fitting rule of a list or of a table (action, host, path).

    A table, or a long list, is joined: each distinct host and path meets the rules of its
    host's suffixes by path prefixes of just the lengths that those rules have, so that
    the number of rules has no bound and no row meets rules that don't fit.
    """
    if not isinstance(rules, DataFrame):
        if len(rules) <= MAX_RULES:
            return rows.withColumn("won", winning(F.col("host"), F.col("path"), rules))
        rules = rows.sparkSession.createDataFrame(rules, "action string, host string, path string")
    known = rules.select("action", F.col("host").alias("r_host"), F.col("path").alias("r_path")).distinct()
    lengths = known.groupBy("r_host").agg(F.collect_set(F.length("r_path")).alias("lengths"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    each = rows.select("host", "path").distinct().where("host <> ''").withColumn("r_host", F.explode(suffixes)).join(lengths, "r_host")
    cut = F.explode(F.expr("filter(lengths, n -> n <= length(path))"))
    fitting = each.withColumn("n", cut).withColumn("r_path", F.expr("substring(path, 1, n)")).join(known, ["r_host", "r_path"])
    rule = F.concat("r_host", "r_path")
    best = fitting.groupBy("host", "path").agg(F.max(F.struct(F.length(rule).alias("n"), (F.col("action") == "allow").cast("int").alias("allow"), rule.alias("rule"), F.col("action"))).alias("won"))
    return rows.join(best, ["host", "path"], "left").select(*rows.columns, "won")


def page_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst) nodes from all redirects and canonical links in the pages' html."""
    u, h = F.col(f"`{url}`"), F.col(f"`{html}`")
    target = F.explode(F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(h, F.lit(p), F.lit(1)) for p in _LINKS])))).alias("to")
    found = pages.where(h.rlike(r"(?i)canonical|refresh|og:url")).select(u.alias("u"), target)
    base = F.regexp_extract("u", r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract("u", r"(?s)^(.*?://[^/?#]*(?:[^?#]*/)?)", 1)
    to = F.col("to")
    full = F.when(to.contains("://"), to).when(to.startswith("//"), F.concat(F.lit("http:"), to)).when(to.startswith("/"), F.concat(base, to)).otherwise(F.concat(folder, to))
    return found.select(node(F.col("u")).alias("src"), node(full).alias("dst"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, *, id_col: str = "page_id", url: str = "url", html: str = "html", edges: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, component) for each row of ``pages``."""
    u = F.col(f"`{url}`")
    links = page_edges(pages, url, html)
    if edges is not None:
        links = links.union(edges.select(node(F.col("src")), node(F.col("dst"))))
    comps = connected_components(links)
    won = pages.select(F.col(f"`{id_col}`").alias("page_id"), host(u).alias("host"), path(u).alias("path"), node(u).alias("node"))
    won = won_by(won, rules)
    # every node of the graph is judged, pages or not
    bare = F.concat(F.lit("x://"), "node")
    of_nodes = won_by(comps.select("component", host(bare).alias("host"), path(bare).alias("path")), rules).select("component", F.col("won")["action"].alias("a"))
    said = won.select("node", F.col("won")["action"].alias("a")).where("a is not null").distinct().join(comps, "node").select("component", "a")
    decided = of_nodes.union(said).groupBy("component").agg(F.max(F.col("a") == "allow").alias("allowed"), F.max(F.col("a") == "block").alias("blocked"))
    by_node = materialize(comps.join(decided, "component"))
    joined = won.join(by_node, "node", "left")
    alias = F.when(F.coalesce(F.col("blocked"), F.lit(False)) & ~F.coalesce(F.col("allowed"), F.lit(False)), "block").otherwise("allow")
    return joined.select("page_id", "host", "path", F.col("won")["rule"].alias("rule"), F.coalesce(F.col("won")["action"], alias).alias("verdict"), "component")


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), RULES).drop("component")


def _sql() -> str:
    def parts(u: str) -> str:
        return (
            f"translate(regexp_extract(coalesce({u}, ''), '^.*?://([^/?#]*)', 1, 's'), '{UPPER}', '{LOWER}') as host, "
            f"regexp_extract(coalesce({u}, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') as path, "
            f"translate(regexp_extract(coalesce({u}, ''), '^.*?://([^/?#]*)', 1, 's'), '{UPPER}', '{LOWER}') || regexp_replace(regexp_extract(coalesce({u}, ''), '^.*?://[^/?#]*([^#]*)', 1, 's'), '/$', '') as node"
        )

    q = lambda s: s.replace("'", "''")
    rules = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in RULES)
    links = " union all ".join(f"select url, unnest(regexp_extract_all(html, '{q(p)}', 1)) as t from pages" for p in _LINKS)
    full = (
        "case when contains(t, '://') then t when starts_with(t, '//') then 'http:' || t when starts_with(t, '/') then regexp_extract(url, '^(.*?://[^/?#]*)', 1, 's') || t "
        "else regexp_extract(url, '^(.*?://[^/?#]*(?:[^?#]*/)?)', 1, 's') || t end"
    )
    best = "select {k}, arg_max(h || p, length(h || p)) as rule, arg_max(a, length(h || p)) as action from {t} join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by {k}"
    return f"""
with recursive rules(a, h, p) as (values {rules}),
won as (select page_id, url, {parts("url")} from pages),
fit as ({best.format(k="page_id", t="won")}),
found as (select url, {full} as target from ({links}) where t <> ''),
ends as (select s.node as src, d.node as dst from (select rowid_, {parts("url")} from (select *, row_number() over () as rowid_ from found)) s
  join (select rowid_, {parts("target")} from (select *, row_number() over () as rowid_ from found)) d using (rowid_) where s.host <> '' and d.host <> ''),
sides as (select src, dst from ends union select dst, src from ends),
reach(src, dst) as (select src, src from sides union select r.src, s.dst from reach r join sides s on r.dst = s.src),
said as (select node, action from won join fit using (page_id)),
bare as (select distinct src as node0, {parts("'x://' || src")} from sides),
bared as (select node0 as node, action from ({best.format(k="node0", t="bare")})),
voted as (select r.src as node, max(action = 'allow') as allowed, max(action = 'block') as blocked from reach r left join (select * from said union select * from bared) v on v.node = r.dst group by r.src)
select page_id, host, path, rule, coalesce(action, case when coalesce(blocked, false) and not coalesce(allowed, false) then 'block' else 'allow' end) as verdict
from won left join fit using (page_id) left join voted v on v.node = won.node and won.host <> ''
"""


OP9_SQL = _sql()
