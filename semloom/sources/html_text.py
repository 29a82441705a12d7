"""Text of an HTML page with its links written out."""

from __future__ import annotations

from html.parser import HTMLParser

MAX_WORDS = 10_000
_SKIPPED = {"script", "style", "head", "title", "noscript", "template"}


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.links: list[str | None] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in _SKIPPED
        if tag == "a":
            self.links.append(dict(attrs).get("href"))

    def handle_endtag(self, tag):
        if tag in _SKIPPED:
            self.skip = max(0, self.skip - 1)
        if tag == "a" and self.links:
            href = self.links.pop()
            if href:
                self.out.append(f" ({href}) ")
        elif tag not in ("b", "i", "em", "strong", "span", "a"):
            self.out.append(" ")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def first_words(text: str, n: int | None = MAX_WORDS) -> str:
    """The first ``n`` words, or all of them, with single spaces between."""
    return " ".join(text.split() if n is None else text.split(None, n)[:n])


def html_to_text(page: str, words: int | None = MAX_WORDS) -> str:
    """The first ``words`` words, each link as ``text (href)``."""
    reader = _Reader()
    reader.feed(page)
    reader.close()
    return first_words("".join(reader.out), words)
