"""URL filter with redirect equivalence.

A rule blocks or allows a host with all its subdomains below a path prefix; of the rules that fit a URL the
longest (host and path together) decides, at equal length an allowing one. Redirect and canonical-link edges make URLs aliases:
all canonical links (`canonical` among the tokens of rel) and refresh redirects of a page are taken from its markup, further
redirects from a table. Comments, scripts, styles, titles and text areas hold no links; of the character references numbers and the names of
ASCII characters are read. Targets are resolved by RFC 3986 against the page's first `base` with an address, itself resolved against
the page's URL, or against that URL. Over the edges'
connected components block decisions reach the aliases: a URL that no rule fits is blocked when a rule
blocks any URL of its component. An explicit allow goes first: a URL that a rule allows is never blocked by an alias.

A URL's node is its host, path and query; scheme and fragment don't make another page.

Nulls: a null url, or one without `://`, has an empty host and path, fits no rule, is no node and so is allowed; null
markup holds no edges, nor does a target of another scheme than http and https; a null page_id is kept. Repeated rows give repeated results, an empty table an empty one;
further columns are not read.
"""

from __future__ import annotations

import html.entities
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import join_facts, materialise
from lectern.llm.components import components

#: (action, host, path)
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]

#: Whole tags, with `>` inside quotes.
LINK, META, BASE_TAG = (rf"""(?is)<{tag}\b(?:[^>"']+|"[^"]*"|'[^']*')*>""" for tag in ("link", "meta", "base"))
#: What holds no elements.
NO_MARKUP = "(?is)<!--.*?-->|" + "|".join(rf"<{tag}\b.*?</{tag}\s*>" for tag in ("script", "style", "title", "textarea"))
#: A character reference with a number, one with a name, or text without either.
PIECES = "&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[A-Za-z][A-Za-z0-9]*;|[^&]+|&"
NAMES = {f"&{name}": c for name, c in html.entities.html5.items() if name.endswith(";") and len(c) == 1 and ord(c) < 128}
#: Facts of so many keys are broadcast; more are joined in parts.
FEW = 200_000
#: A refresh: seconds, then the address, in quotes or not.
REFRESH = r"""(?is)^[\s]*[\d.]*[\s]*[;,\s][\s]*(?:url[\s]*=[\s]*)?(?:"([^"]*)|'([^']*)|([^"'\s].*))"""
#: scheme, authority, path and query of a base URL.
BASE = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)"


def _rest(url: Column) -> Column:
    """What follows the first ://, empty without one."""
    url = F.coalesce(url, F.lit(""))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """The node of a URL; null if it is none. An empty path is the path /."""
    path = path_of(url)
    node = F.concat(host_of(url), F.when(path == "", "/").otherwise(path), F.regexp_extract(_rest(url), r"^[^?#]*(\?[^#]*)", 1))
    return F.when(_rest(url) != "", node)


def unescaped(text: Column) -> Column:
    """text with its character references read; a number that is no character gives U+FFFD."""
    # one literal that is folded to a map; a call with each pair would make the plan long
    names = F.str_to_map(F.lit("\x02".join(f"{name}\x01{c}" for name, c in NAMES.items())), F.lit("\x02"), F.lit("\x01"))

    def read(piece: Column) -> Column:
        hexed, digits = (F.regexp_extract(piece, p, 1) for p in ("^&#[xX]0*([0-9a-fA-F]*)", "^&#0*([0-9]*)"))
        code = F.when(piece.rlike("^&#[xX]"), F.when(F.length(hexed) < 7, F.conv(hexed, 16, 10))).when(F.length(digits) < 8, digits)
        code = code.try_cast("long")
        valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("\ufffd")
        return F.when(piece.startswith("&#") & (F.length(piece) > 2), char).otherwise(F.coalesce(F.try_element_at(names, piece), piece))

    whole = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(PIECES), 0), read), "")
    return F.when(F.instr(text, "&") > 0, whole).otherwise(text)


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's first attribute of that name, without quotes and references; empty without one."""
    pattern = rf"""(?is)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return unescaped(F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)]))


def without_dots(path: Column) -> Column:
    """An absolute path without its `.` and `..` segments."""
    parts = F.split(path, "/")
    done = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda kept, x: F.when(x == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))).when(x == ".", kept).otherwise(F.array_append(kept, x)),
    )
    ends = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(done, ends), "/")


def absolute(target: Column, base: Column) -> Column:
    """target as an absolute URL, resolved against base; null if it is none of http or https, or names base's own document."""
    target = F.regexp_replace(target, r"^\s+|\s+$", "")
    scheme, authority, path = (F.regexp_extract(base, BASE, i) for i in (1, 2, 3))
    own = F.regexp_extract(target, "(?s)^[^?#]*", 0)
    rest = F.regexp_extract(target, "(?s)^[^?#]*(.*)$", 1)
    host = F.concat(scheme, F.lit("://"), authority)
    folder = F.when(path == "", "/").otherwise(F.regexp_extract(path, "(?s)^(.*/)", 1))

    def placed(front: Column, below: Column) -> Column:
        """below split into authority and path, the path without dots."""
        return F.concat(front, F.regexp_extract(below, "(?s)^[^/]*", 0), without_dots(F.regexp_extract(below, "(?s)^[^/]*(.*)$", 1)), rest)

    full = F.regexp_extract(own, "(?is)^(https?://)", 1)
    return (
        F.when(full != "", placed(full, F.regexp_extract(own, "(?is)^https?://(.*)$", 1)))
        .when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | (scheme == "") | (target == "") | target.startswith("#"), None)
        .when(own.startswith("//"), placed(F.concat(scheme, F.lit("://")), F.regexp_extract(own, "(?s)^//(.*)$", 1)))
        .when(own.startswith("/"), F.concat(host, without_dots(own), rest))
        .when(own == "", F.concat(host, path, rest))
        .otherwise(F.concat(host, without_dots(F.concat(folder, own)), rest))
    )


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The deciding rule as struct (action, rule), or null."""
    out = None
    for action, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        made = F.struct(F.lit(action).alias("action"), F.lit(h + p).alias("rule"))
        out = F.when(fits, made) if out is None else out.when(fits, made)
    return out if out is not None else F.lit(None).cast("struct<action:string,rule:string>")


def edges_of(pages: DataFrame) -> DataFrame:
    """from_url, to_url: the pages' canonical links and refresh redirects. Written at each step, as a value is used many times over in the next."""
    low = F.lower(F.coalesce("html", F.lit("")))
    body = F.regexp_replace(F.coalesce("html", F.lit("")), NO_MARKUP, " ")
    # the plain tests spare most pages the regular expressions; references may hide either word
    wanted = low.contains("canonical") | low.contains("http-equiv") | low.contains("&#")
    found = pages.filter(wanted).select(F.col("url").alias("from_url"), low.contains("<base").alias("any"), body.alias("body"))
    bases = F.when(F.col("any"), F.regexp_extract_all("body", F.lit(BASE_TAG), 0))
    tags = found.select("from_url", bases.alias("bases"), F.explode(F.concat(*[F.regexp_extract_all("body", F.lit(p), 0) for p in (LINK, META)])).alias("tag"))
    tags = materialise(tags, "page-tags")
    holds = lambda name, token: F.array_contains(F.split(F.lower(F.col(name)), r"\s+"), token)
    base = F.try_element_at(F.filter(F.transform("bases", lambda t: attribute(t, "href")), lambda h: h != ""), F.lit(1))
    values = materialise(tags.select("from_url", F.lower(F.left("tag", F.lit(5))).alias("kind"), base.alias("base"), *[attribute(F.col("tag"), n).alias(n.replace("-", "_")) for n in ("rel", "href", "http-equiv", "content")]), "page-links")
    told = F.concat(*[F.regexp_extract("content", REFRESH, i) for i in (1, 2, 3)])
    target = F.when((F.col("kind") == "<link") & holds("rel", "canonical"), F.col("href")).when((F.col("kind") == "<meta") & holds("http_equiv", "refresh"), told)
    links = values.select("from_url", "base", target.alias("target")).filter("target IS NOT NULL")
    based = materialise(links.filter("base IS NOT NULL").select("from_url", absolute(F.col("base"), F.col("from_url")).alias("against"), "target"), "based-links")
    plain = links.filter("base IS NULL").select("from_url", F.col("from_url").alias("against"), "target")
    against = plain.unionByName(based.withColumn("against", F.coalesce("against", "from_url")))
    return materialise(against.select("from_url", absolute(F.col("target"), F.col("against")).alias("to_url")), "page-edges").filter("to_url IS NOT NULL")


def meet(rows: DataFrame, facts: DataFrame, key: str, spread: list[str], how: str) -> DataFrame:
    """rows joined with facts, which are written and one row a key: broadcast when FEW, otherwise hot keys meet theirs in parts."""
    if facts.count() <= FEW:
        return rows.join(F.broadcast(facts), key, how)
    sizes = materialise(facts.join(rows.groupBy(key).agg(F.count("*").alias("__n")), key), "meeting")
    total = sizes.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n")).first()["n"]
    out = join_facts(rows.filter(F.col(key).isNotNull()), sizes, key, "__n", total, spread, how)
    return out if how == "inner" else out.unionByName(rows.filter(F.col(key).isNull()), allowMissingColumns=True)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of every page. redirects: (from_url, to_url) beyond the markup's."""
    rules = RULES if rules is None else rules
    edges = edges_of(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("from_url", "to_url"))
    urls = materialise(edges.filter(node_of(F.col("from_url")).isNotNull() & node_of(F.col("to_url")).isNotNull()).filter(node_of(F.col("from_url")) != node_of(F.col("to_url"))).distinct(), "url-edges")
    roots = components(urls.select(node_of(F.col("from_url")).alias("u"), node_of(F.col("to_url")).alias("v")))
    member = roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct()
    # the URLs of edges are judged too, pages or not
    ends = urls.select(F.explode(F.array("from_url", "to_url")).alias("url")).select(node_of(F.col("url")).alias("node"), rule_of(host_of(F.col("url")), path_of(F.col("url")), rules).alias("r")).distinct()
    blocked = materialise(ends.filter("r.action = 'block'").join(member, "node").select("root").distinct(), "blocked-roots")
    tainted = materialise(meet(member, blocked, "root", ["node"], "inner").select("node", F.lit(True).alias("tainted")).distinct(), "tainted")
    judged = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node"))
    judged = meet(judged.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)), tainted, "node", ["page_id"], "left")
    return judged.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.action", F.when(F.col("tainted"), "block").otherwise("allow")).alias("verdict"))
