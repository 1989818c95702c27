"""The links of pages and the verdicts on them, by plain code."""

from __future__ import annotations

import re
import string
from html.parser import HTMLParser
from urllib.parse import urljoin


def markup_edges(pages: list[tuple]) -> list[tuple[str, str]]:
    """(from, to) of (url, html) pages by an HTML parser and the standard library's resolution."""
    found: list[tuple[str, str]] = []

    class Tags(HTMLParser):
        def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
            self.closed += tag in ("title", "textarea")
            if self.closed:
                return
            own = {}
            for k, v in attrs:
                own.setdefault(k, v or "")
            if tag == "base" and own.get("href") and self.base is None:
                self.base = own["href"].strip()
            if tag == "link" and "canonical" in own.get("rel", "").lower().split():
                self.targets.append(own.get("href", ""))
            if tag == "meta" and "refresh" in own.get("http-equiv", "").lower().split():
                _, _, told = own.get("content", "").partition(";")
                told = told.strip()
                told = told[3:].lstrip()[1:].lstrip() if told.lower().startswith("url") else told
                self.targets.append(told[1:].partition(told[0])[0] if told[:1] in ("'", '"') else told)

        def handle_endtag(self, tag: str) -> None:
            self.closed -= tag in ("title", "textarea")

    for url, html in pages:
        parser = Tags()
        parser.closed = 0
        parser.targets, parser.base = [], None
        parser.feed(html or "")
        base = urljoin(url or "", parser.base or "")
        base = base if base.split(":")[0].lower() in ("http", "https") else url
        for t in (x.strip() for x in parser.targets):
            to = urljoin(base or "", t)
            if url and "://" in url and t and not t.startswith("#") and to.split(":")[0].lower() in ("http", "https"):
                found.append((url, to))
    return found


def brute_force(pages: list[tuple], rules: list[tuple[str, str, str]], redirects: list[tuple[str, str]]) -> dict:
    """page_id: verdict by plain loops over explicit redirects."""

    def parts(url: str | None) -> tuple[str, str, str]:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        m = re.match(r"([^/?#]*)([^?#]*)([^#]*)", rest)
        host = "".join(c.lower() if c in string.ascii_uppercase else c for c in m[1])
        return host, m[2], host + (m[2] or "/") + m[3] if rest else ""

    def rule(url: str | None) -> str | None:
        host, path, _ = parts(url)
        fit = [(len(h + p), a == "allow", a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fit)[2] if fit else None

    near: dict[str, set[str]] = {}
    acts: dict[str, set] = {}
    for a, b in redirects:
        for x, y in ((a, b), (b, a)):
            near.setdefault(parts(x)[2], set()).add(parts(y)[2])
            acts.setdefault(parts(x)[2], set()).add(rule(x))
    out = {}
    for page, url in pages:
        seen, todo = set(), [parts(url)[2]]
        while todo:
            if (n := todo.pop()) not in seen:
                seen.add(n)
                todo += near.get(n, ())
        out[page] = rule(url) or ("block" if any("block" in acts.get(n, ()) for n in seen if n) else "allow")
    return out
