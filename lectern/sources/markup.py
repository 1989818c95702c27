"""Articles in JATS markup and pages in HTML."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_ARTICLE, MOST_ARTICLE, FIGURES = 600, 120_000, 8

# Elements whose content isn't prose, and files that are no figures.
NOISE = {
    "xref", "table-wrap", "table", "graphic", "inline-graphic",
    "disp-formula", "inline-formula", "media", "supplementary-material",
    "fig", "ref-list", "back",
}
NO_FIGURE = ["logo", "icon", "orcid", "cover", "banner", "headshot"]

ARTICLE = "struct<title:string,content:string,pmcid:string,pmid:string,doi:string,journal:string,year:string,licence:string,figures:array<struct<label:string,caption:string,href:string,fig_id:string>>>"


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def prose(element: ET.Element | None, skip: frozenset[str] | set[str] = frozenset()) -> str:
    """All text below element with single blanks between pieces; what follows a skipped element stays."""
    pieces: list[str] = []

    def walk(e: ET.Element) -> None:
        pieces.append(e.text or "")
        for child in e:
            if local(child.tag) not in skip:
                walk(child)
            pieces.append(child.tail or "")

    if element is not None:
        walk(element)
    return " ".join(" ".join(pieces).split())


def _under(root: ET.Element, *names: str) -> ET.Element | None:
    """The first element that is reached through names in order, whatever lies between."""
    found = [root]
    for name in names:
        found = [e for f in found for e in f.iter() if local(e.tag) == name and e is not f]
        if not found:
            return None
    return found[0]


def _attribute(element: ET.Element, name: str) -> str:
    return next((v for k, v in element.attrib.items() if local(k) == name), "")


def licence(root: ET.Element) -> str:
    for node in (e for e in root.iter() if local(e.tag) == "license"):
        href = _attribute(node, "href")
        if "creativecommons.org" in href:
            kind, _, version = href.rstrip("/").partition("/licenses/")[2].partition("/")
            return f"CC-{kind.upper()} {version.split('/')[0]}" if kind and version else href
        told = (node.get("license-type") or "").strip() or prose(node)[:200]
        if told:
            return told
    return ""


def open_access(root: ET.Element) -> bool:
    """Whether a licence says so; without one the answer is no."""
    for node in (e for e in root.iter() if local(e.tag) == "license"):
        told = f"{node.get('license-type') or ''} {_attribute(node, 'href')} {prose(node)}".lower()
        if any(mark in told for mark in ("open", "creativecommons.org", "cc-by")):
            return True
    return False


def figures(root: ET.Element) -> list[dict]:
    """Figures with an image, before noise goes (their captions are noise in prose)."""
    out = []
    for fig in (e for e in root.iter() if local(e.tag) == "fig"):
        images = (_attribute(e, "href") for e in fig.iter() if local(e.tag) in ("graphic", "inline-graphic"))
        if href := next(filter(None, images), ""):
            own = {local(c.tag): prose(c) for c in fig}
            out.append({"label": own.get("label", ""), "caption": own.get("caption", ""), "href": href, "fig_id": fig.get("id") or ""})
    return out


def article(markup: str | None) -> dict | None:
    """The record of one article's markup; None if it can't be parsed or isn't taken."""
    try:
        return record(ET.fromstring(markup or ""))
    except ET.ParseError:
        return None


def record(root: ET.Element) -> dict | None:
    """The record of one article; None without open access, a title or enough text."""
    title = prose(_under(root, "article-meta", "article-title"))
    if not title or not open_access(root):
        return None
    ids = {e.get("pub-id-type"): (e.text or "").strip() for e in root.iter() if local(e.tag) == "article-id"}
    journal, year = prose(_under(root, "journal-meta", "journal-title")), prose(_under(root, "article-meta", "pub-date", "year"))
    abstract, body = prose(_under(root, "article-meta", "abstract"), NOISE), prose(_under(root, "body"), NOISE)
    heading = f"Journal: {journal}{f' ({year})' if year else ''}" if journal else ""
    content = "\n\n".join(filter(None, [title, heading, abstract and f"Abstract: {abstract}", body]))
    if len(content) < LEAST_ARTICLE:
        return None
    if len(content) > MOST_ARTICLE:
        content = content[:MOST_ARTICLE] + "\n\n[truncated]"
    return {
        "title": title, "content": content, "pmcid": ids.get("pmc", ""), "pmid": ids.get("pmid", ""), "doi": ids.get("doi", ""),
        "journal": journal, "year": year, "licence": licence(root), "figures": figures(root) if _under(root, "body") is not None else [],
    }


def articles(rows: DataFrame, markup: str = "xml") -> DataFrame:
    """rows with the struct `article`, null where there is none."""

    @F.pandas_udf(ARTICLE)
    def run(texts: pd.Series) -> pd.DataFrame:
        fields = ["title", "content", "pmcid", "pmid", "doi", "journal", "year", "licence", "figures"]
        return pd.DataFrame([article(t) or dict.fromkeys(fields) for t in texts], columns=fields)

    parsed = rows.withColumn("article", run(F.col(markup)))
    return parsed.withColumn("article", F.when(F.col("article.title").isNotNull(), F.col("article")))


def figure_rows(parsed: DataFrame, key: str, most: int = FIGURES) -> DataFrame:
    """key, pos and figure: the first figures of each article that aren't decoration."""
    wanted = F.filter("article.figures", lambda f: ~decorative(f["href"]))
    return parsed.select(key, F.posexplode(F.slice(wanted, 1, most)).alias("pos", "figure"))


def decorative(href: Column) -> Column:
    return F.lower(href).rlike("|".join(NO_FIGURE))


def page_text(html: Column) -> Column:
    """The prose of a page: no scripts, styles, comments and tags, single blanks."""
    text = F.coalesce(html, F.lit(""))
    for pattern in (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"(?s)<!--.*?-->", r"<[^>]+>"):
        text = F.regexp_replace(text, pattern, " ")
    return F.trim(F.regexp_replace(text, r"[ \t\n\r]+", " "))


def licence_of_link(href: Column) -> Column:
    """`CC-BY-NC 4.0` from a Creative Commons link; other links as they are."""
    kind, version = (F.regexp_extract(href, r"creativecommons\.org/licenses/([^/]+)/([^/]+)", i) for i in (1, 2))
    return F.when(kind != "", F.concat(F.lit("CC-"), F.upper(kind), F.lit(" "), version)).otherwise(href)


def article_number(url: Column, filename: Column) -> Column:
    """The archive number from a link, else from a file's name; empty without one."""
    found = [F.regexp_replace(F.regexp_extract(F.coalesce(x, F.lit("")), p, 1), r"\D", "") for x, p in ((url, r"^.*/PMC(.*)$"), (filename, r"^.*PMC(.*)$"))]
    digits = F.when(found[0] != "", found[0]).otherwise(found[1])
    return F.when(digits != "", F.concat(F.lit("PMC"), digits)).otherwise("")


def figure_url(archive: Column, number: Column, href: Column) -> Column:
    """The address of an article's figure; the number with or without its letters."""
    bare = F.trim(number)
    return F.concat(archive, F.lit("/"), F.when(F.upper(bare).startswith("PMC"), bare).otherwise(F.concat(F.lit("PMC"), bare)), F.lit("/bin/"), href)
