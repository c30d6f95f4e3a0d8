"""HTML that patterns can't read: a parser over Arrow batches."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame


class _Visible(HTMLParser):
    """Text outside script, style and head; block ends are line ends."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "head"):
            self.hidden += 1
        elif tag in ("p", "br", "div", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6"):
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "head") and self.hidden:
            self.hidden -= 1
        elif tag in ("p", "div"):
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


class _Container(HTMLParser):
    """Paragraphs inside the element of a class."""

    def __init__(self, name: str):
        super().__init__(convert_charrefs=True)
        self.name, self.depth, self.open, self.now, self.out = name, 0, False, [], []

    def handle_starttag(self, tag, attrs):
        if tag == "div":
            if self.depth or self.name in (dict(attrs).get("class") or "").split():
                self.depth += 1
        elif tag == "p" and self.depth:
            self.open, self.now = True, []

    def handle_endtag(self, tag):
        if tag == "div" and self.depth:
            self.depth -= 1
        elif tag == "p" and self.open:
            self.open = False
            text = " ".join("".join(self.now).split())
            if len(text) > 10:
                self.out.append(text)

    def handle_data(self, data):
        if self.open:
            self.now.append(data)


def _mapped(df: DataFrame, key: str, col: str, fn) -> DataFrame:
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if t is None else fn(t) for t in b.column(1).to_pylist()], pa.string())], names=[key, "text"])

    return df.select(key, col).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, text string")


def visible_text(df: DataFrame, key: str, col: str) -> DataFrame:
    """(key, text): null stays null, malformed mark-up is read as far as it goes."""

    def text(html: str) -> str:
        p = _Visible()
        p.feed(html)
        p.close()
        lines = (" ".join(x.split()) for x in "".join(p.out).split("\n"))
        return "\n".join(x for x in lines if x)

    return _mapped(df, key, col, text)


def container_paragraphs(df: DataFrame, key: str, col: str, name: str = "cm-single-description") -> DataFrame:
    """(key, text): the paragraphs of the container, parted by blank lines."""

    def text(html: str) -> str:
        p = _Container(name)
        p.feed(html)
        p.close()
        return "\n\n".join(p.out)

    return _mapped(df, key, col, text)
