"""URL filter whose block decisions reach all aliases of a page.

A URL is judged by the longest rule that fits it. URLs that no rule fits take
part in an equivalence: redirects and canonical links join URLs into components,
and a block anywhere in a component blocks every member without a rule of its
own. A URL with an allow rule of its own stays allowed, whatever its aliases are.

Built-in columns only.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelake.core import DataContractError, durable
from sitelake.llm.components import components
from sitelake.llm.frames import lower_az

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)"
#: Rule tables up to this many rows are broadcast; larger ones are shuffled.
SMALL_RULES = 10_000


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]] = RULES) -> DataFrame:
    """``(verdict, host, path)``; of rules with the same host and path, allow wins."""
    rows = [(v, h.lower(), p) for v, h, p in rules]
    made = spark.createDataFrame(rows, "verdict string, rule_host string, rule_path string")
    return made.groupBy("rule_host", "rule_path").agg(F.min("verdict").alias("verdict"))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return lower_az(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def node_of(url: Column) -> Column:
    """Name of a URL in the alias graph: host, path and query; null where there is no ``://``.

    The scheme and the fragment do not make another page.
    """
    u = F.coalesce(url, F.lit(""))
    return F.when(F.instr(u, "://") > 0, F.concat(host_of(u), path_of(u), F.regexp_extract(u, PARTS, 3)))


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute, in either kind of quotes or in none; empty if it is not there."""
    pattern = rf"""(?is)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.concat(*[F.regexp_extract(tag, pattern, g) for g in (1, 2, 3)])


def unescape(text: Column) -> Column:
    """Numeric character references, ``&amp;``, ``&quot;``, ``&lt;`` and ``&gt;`` as their characters; all others stay."""
    pieces = F.regexp_extract_all(text, F.lit("(?s)&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};|&[a-z]{2,4};|[^&]+|&"), F.lit(0))

    def character(code: Column, piece: Column) -> Column:
        real = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(real, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(piece)

    def plain(p: Column) -> Column:
        return (
            F.when(p.rlike("^&#[0-9]"), character(F.regexp_extract(p, "([0-9]+)", 1).cast("long"), p))
            .when(p.rlike("^&#[xX]"), character(F.conv(F.regexp_extract(p, "[xX]([0-9A-Fa-f]+)", 1), 16, 10).cast("long"), p))
            .when(p == "&amp;", "&").when(p == "&quot;", '"').when(p == "&lt;", "<").when(p == "&gt;", ">").otherwise(p)
        )

    return F.array_join(F.transform(pieces, plain), "")


def resolved(df: DataFrame, target: str, base: str, out: str) -> DataFrame:
    """``df`` with ``target`` as a full address in ``out``, seen from ``base`` and without ``.`` and ``..`` segments.

    Null for other schemes and for places within the page. Each step is a column
    of its own: one nested expression would hold thousands of copies of its parts.
    """
    names = {n: f"__{n}_{out}" for n in ("scheme", "site", "path", "folder", "whole", "own", "parts", "held")}
    c = {n: F.col(v) for n, v in names.items()}
    t, b = F.col(target), F.col(base)
    df = df.withColumns({names["scheme"]: F.regexp_extract(b, r"(?s)^(.*?)://", 1), names["site"]: F.regexp_extract(b, r"(?s)^(.*?://[^/?#]*)", 1), names["path"]: path_of(b)})
    df = df.withColumn(names["folder"], F.regexp_extract(c["path"], r"(?s)^(.*/)", 1))
    df = df.withColumn(names["whole"], (
        F.when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), t)
        .when(t.startswith("//"), F.concat(c["scheme"], F.lit(":"), t))
        .when(t.startswith("/"), F.concat(c["site"], t))
        .when(t.startswith("?"), F.concat(c["site"], c["path"], t))
        .when(t.startswith("#") | t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .otherwise(F.concat(c["site"], F.when(c["folder"] == "", F.lit("/")).otherwise(c["folder"]), t))
    ))
    df = df.withColumn(names["own"], path_of(c["whole"])).withColumn(names["parts"], F.split(c["own"], "/"))
    df = df.withColumn(names["held"], F.aggregate(
        F.slice(c["parts"], F.lit(2), F.size(c["parts"])), F.array().cast("array<string>"),
        lambda held, s: F.when(s == "..", F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(0)))).when(s == ".", held).otherwise(F.concat(held, F.array(s)))))
    folder = F.when(F.element_at(c["parts"], -1).isin(".", "..") & (F.size(c["held"]) > 0), F.lit("/")).otherwise(F.lit(""))
    head, tail = F.regexp_extract(c["whole"], r"(?s)^(.*?://[^/?#]*)", 1), F.regexp_extract(c["whole"], r"(?s)^.*?://[^/?#]*[^?#]*(.*)$", 1)
    plain = F.concat(head, F.lit("/"), F.array_join(c["held"], "/"), folder, tail)
    dotted = c["own"].startswith("/") & c["own"].rlike(r"/\.{1,2}(/|$)")
    return df.withColumn(out, F.when(dotted, plain).otherwise(c["whole"])).drop(*names.values())


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(from_url, to_url)`` of canonical links and refresh redirects that the pages state; duplicates included.

    Counted are ``<link>`` tags with ``canonical`` among the words of ``rel``, and
    ``<meta http-equiv=refresh>`` with a ``url=`` in ``content``. Attributes may be
    quoted or not; character references are read. Targets are resolved against the
    page's ``<base href>`` (itself against the page) or else the page: absolute ones,
    ``//host``, ``/path``, ``?query`` and relative ones, without ``.`` and ``..``.
    """
    tags = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r"""(?is)<(?:link|meta|base)\b[^>]*>"""), F.lit(0))
    bases = F.filter(F.transform(F.filter("tags", lambda t: t.rlike("(?i)^<base")), lambda t: _attribute(t, "href")), lambda h: F.trim(h) != "")
    found = pages.select(F.col(url).alias("from_url"), tags.alias("tags")).where("from_url is not null and size(tags) > 0")
    found = found.select("from_url", F.try_element_at(bases, F.lit(1)).alias("base"), F.explode("tags").alias("tag"))
    words = F.split(F.lower(_attribute(F.col("tag"), "rel")), r"\s+")
    canonical = F.col("tag").rlike("(?i)^<link") & F.array_contains(words, "canonical")
    refresh = F.col("tag").rlike("(?i)^<meta") & (F.lower(F.trim(_attribute(F.col("tag"), "http-equiv"))) == "refresh")
    value = F.when(canonical, _attribute(F.col("tag"), "href")).when(refresh, _attribute(F.col("tag"), "content"))
    # A row per stated link, written after every step: in one plan the steps would multiply each other's expressions.
    found = durable(found.select("from_url", "base", canonical.alias("canonical"), value.alias("value")).where("value <> ''"), "stated")
    found = durable(found.select("from_url", "canonical", *[F.trim(unescape(F.col(c))).alias(c) for c in ("base", "value")]), "read")
    found = durable(resolved(found, "base", "from_url", "base_url").select("from_url", "canonical", "value", F.coalesce("base_url", "from_url").alias("base")), "based")
    stated = F.regexp_extract("value", r"""(?is)\burl\s*=\s*["']?([^"'\s]*)""", 1)
    found = found.select("from_url", "base", F.when(F.col("canonical"), F.col("value")).otherwise(stated).alias("t")).where("t <> ''")
    return durable(resolved(found, "t", "base", "to_url").select("from_url", "to_url"), "links")


def match_rules(places: DataFrame, rules: DataFrame) -> DataFrame:
    """The longest fitting rule of each distinct ``(host, path)`` that has one: ``(host, path, rule, verdict)``.

    A rule fits its host and all subdomains, if the path starts with the rule's
    path. Each place is expanded to its own host suffixes and to the path
    prefixes of the lengths that occur in the rules, which makes the match an
    equi-join: a common host meets only the rules that fit it.
    """
    sizes = [r[0] for r in rules.select(F.length("rule_path")).distinct().limit(SMALL_RULES + 1).collect()]
    if len(sizes) > SMALL_RULES:
        raise DataContractError(f"rule paths of more than {SMALL_RULES} lengths")
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    prefixes = F.transform(
        F.filter(F.lit(sizes).cast("array<int>"), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n)
    )
    wide = places.select("host", "path", F.explode(suffixes).alias("rule_host")).select(
        "host", "path", "rule_host", F.explode(prefixes).alias("rule_path")
    )
    few = rules.limit(SMALL_RULES + 1).count() <= SMALL_RULES
    found = wide.join(F.broadcast(rules) if few else rules, ["rule_host", "rule_path"])
    rule = F.concat("rule_host", "rule_path")
    best = F.max(F.struct(F.length(rule).alias("n"), rule.alias("rule"), F.col("verdict"))).alias("best")
    return found.groupBy("host", "path").agg(best).select("host", "path", "best.rule", "best.verdict")


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    redirects: DataFrame | None = None,
    page_id: str = "page_id",
    url: str = "url",
    html: str | None = "html",
    default: str = "allow",
) -> DataFrame:
    """``(page_id, host, path, rule, verdict)``, one row per row of ``pages``.

    ``redirects(from_url, to_url)`` adds known redirects, in full, to the links that the
    pages state themselves (see ``page_links`` for the forms that count). Link targets that are no pages still carry the
    verdict of their rule into the component. A URL without rule and without
    blocked alias gets ``default``. Null and malformed URLs have empty host and
    path, fit no rule and get ``default``; empty tables give empty results; rows
    with the same URL get the same verdict.
    """
    base = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    links = [page_links(pages, url, html)] if html else []
    if redirects is not None:
        links.append(redirects.select("from_url", "to_url"))
    judged = base.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node"))
    ends = None
    if links:
        stated = links[0] if len(links) == 1 else links[0].unionByName(links[1])
        both = stated.where("from_url is not null and to_url is not null")
        ends = durable(
            both.select(
                node_of(F.col("from_url")).alias("u"), node_of(F.col("to_url")).alias("v"),
                host_of(F.col("from_url")).alias("uh"), path_of(F.col("from_url")).alias("up"),
                host_of(F.col("to_url")).alias("vh"), path_of(F.col("to_url")).alias("vp"),
            ).where("u is not null and v is not null and u <> v").distinct(),
            "aliases",
        )
    places = judged.select("host", "path").where("host <> ''").distinct()
    matched = match_rules(places, rules).withColumnsRenamed({"host": "mh", "path": "mp"})
    judged = judged.join(matched, (F.col("host") == F.col("mh")) & (F.col("path") == F.col("mp")), "left")
    if ends is None or ends.isEmpty():
        return judged.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
    nodes = ends.select(F.col("u").alias("node"), F.col("uh").alias("host"), F.col("up").alias("path")).unionByName(
        ends.select(F.col("v").alias("node"), F.col("vh").alias("host"), F.col("vp").alias("path"))
    ).distinct()
    blocked_places = match_rules(nodes.select("host", "path").distinct(), rules).where("verdict = 'block'")
    member = components(ends.select("u", "v"))
    blocked = nodes.join(blocked_places, ["host", "path"], "left_semi").select("node").distinct()
    bad = durable(
        member.join(member.join(blocked, "node", "left_semi").select("component").distinct(), "component", "left_semi").select("node").distinct().withColumn("aliased", F.lit(True)),
        "blocked",
    )
    return judged.join(bad, "node", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("verdict", F.when(F.col("aliased"), F.lit("block")), F.lit(default)).alias("verdict"),
    )
