"""Problem 9: keyword-stuffed and link-list pages.

A text is cut into blocks, and each is brought to the words a reader is given: markup is taken off, the texts of attributes
are put in, disguised letters undone, and what stands in lists of links, tags and numbers becomes one mark each.  The block's
redundancy is what that compresses to, divided by what prose of the block's length and language compresses to.  Extreme
redundancy with few sentence ends is spam, and so is utter redundancy even in the shape of sentences.  Rules only take blocks
out again: logs, tables and code repeat their form and inform all the same.  A page is spam if such blocks hold more than
half of its text.

Defined results: null and blank texts are not spam; each ``doc_id`` is given once, if any of its rows is spam; very long
texts are processed whole, block by block; one or two links, and up to three tags, are mentions and stay as they are.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..session import spread

#: Above this share of its characters a text counts as spam.
SHARE = 0.5
#: Redundancy (ratio over expected ratio) below which a block without sentences, or any block, is spam.
LIST_BELOW, ANY_BELOW = 0.70, 0.55
#: Sentence ends a word (or mark) below which a block has few.
FEW_ENDS = 0.02
#: Links and tags that make a list.
LINKS, TAGS = 3, 4
#: Longest block that is scored as one; zlib's window is 32 KB.
BLOCK = 6000

# Frequent words of languages, to tell them apart, and how prose of each compresses against English.
_COMMON = {
    "en": frozenset("the of and to in is that for with on as this are be by it from".split()),
    "de": frozenset("der die das und ist nicht ein eine den zu mit auf für sich werden".split()),
    "fr": frozenset("le la les des une est et dans que pour qui sur pas au du".split()),
    "es": frozenset("el la los las una es y en que para por del con se al".split()),
}
_FACTOR = {"en": 1.0, "de": 0.92, "fr": 0.9, "es": 0.9}

_URL = re.compile(r"(?:https?://|www\.)[^\s<>\"')\]]+|^[ \t*•-]*[\w-]+(?:\.[\w-]+)+(?:/\S*)?[ \t\r]*$", re.I | re.M)
_HOST = re.compile(r"^[ \t*•-]*[\w-]+(?:\.[\w-]+)+(?:/\S*)?[ \t\r]*$", re.M)
_MD_LINK = re.compile(r"!?\[([^\]\n]*)\]\(\s*(?:https?://|www\.|/)[^)\s]*\)", re.I)
_TAG = re.compile(r"<!--|-->|</?[a-z][a-z0-9]*(?:\s[^<>]*)?/?>", re.I)
_ATTRIBUTE = re.compile(r"\b(?:alt|title|content|placeholder|aria-label|value)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", re.I)
_HASH = re.compile(r"(?<!\S)[#@][^\W\d][\w-]*")
_NUMBER = re.compile(r"\d[\d.,:/_-]*")
_HOLDER = re.compile(r"<(?:a|img)\b[^<>]*>", re.I)
_LOG = re.compile(r"\s*(?:\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d|\[?\d\d:\d\d:\d\d|[A-Z][a-z]{2}\s+\d{1,2}\s\d\d:\d\d:\d\d|(?:DEBUG|INFO|WARN(?:ING)?|ERROR|TRACE|FATAL)\b)")
_ROW = re.compile(r"\s*\|.*\|\s*$")
_END = re.compile(r"[.!?。！？…](?=[\s\"'”’)\]*_`]|$)")
_WORD = re.compile(r"[^\W_]+(?:['’_-][^\W_]+)*")
_CODE = re.compile(r"^\s*(?:def |class |import |from \w+ import|return\b|if .*[:{]$|for .*[:{]$|while .*[:{]$|else\b.*[:{]$|try\b|\}|@\w|const |let |var |export |function |public |private |@@ |diff --git|[\w.\[\]]+\s*[-+*/|&]?=[^=]|\w+\(.*\)[;:]?$|//|#\s|/\*|\*/)")
# Digits and signs that stand for letters in disguised words.
_LEET = str.maketrans({"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"})


def language(words: list[str]) -> str:
    often = Counter(words)
    counts = {k: sum(map(often.get, v & often.keys())) for k, v in _COMMON.items()}
    best = max(counts, key=counts.get)
    return best if counts[best] else "en"


def redundancy(text: str, length: int | None = None) -> float:
    """Compressed size over that of prose of ``length`` characters (the text's own if not given) in the text's language; about
    1 for prose, near 0 for repetition.  Short prose compresses to its own length."""
    length = len(text) if length is None else length
    if not text or length <= 0:
        return 1.0
    expected = length * min(1.0, 0.38 + 4.0 / length**0.5) * _FACTOR[language(text.split())]
    return max(0, len(zlib.compress(text.encode("utf-8", "replace"), 6)) - 8) / expected


_DISGUISED = re.compile(r"(?<!\S)[^\s\d]*\d\S*")


def _plain(words: list[str]) -> str:
    """The words in lower case, digits that stand for letters undone where a word holds both."""
    text = " ".join(words).lower()
    return _DISGUISED.sub(lambda m: m[0] if m[0].isdigit() else m[0].translate(_LEET), text)


def _size(text: str) -> int:
    return sum(map(len, text.split()))


def canonical(block: str) -> tuple[str, int, int]:
    """(words and marks of a block, characters they stand for, marks).  A link is one mark, a tag is one, a number is 0."""
    held = marks = 0

    def link(m: re.Match) -> str:
        nonlocal held, marks
        label = m[1] if m.re is _MD_LINK else ""
        held, marks = held + len(m[0]) - len(label) - 1, marks + 1
        return f" {label} \u00a4 "

    def tag(m: re.Match) -> str:
        nonlocal held, marks
        held, marks = held + len(m[0]) - 1, marks + 1
        return "#"

    text, said = block, ""
    holders = _HOLDER.findall(text) if "<" in text else ()
    plain = _HOLDER.sub(" ", text) if holders else text
    urls = _URL if "://" in plain or "www." in plain or "WWW." in plain else _HOST
    if len(holders) + len(urls.findall(plain)) >= LINKS:
        text = _MD_LINK.sub(link, text) if "](" in text else text
        said = " ".join(a or b for a, b in _ATTRIBUTE.findall(text)) if "<" in text else ""
        text = _URL.sub(link, _HOLDER.sub(link, text) if holders else text)
        held -= len(said) if holders else 0
    elif "<" in text:
        said = " ".join(a or b for a, b in _ATTRIBUTE.findall(text))
    if "<" in text:
        text = html.unescape(_TAG.sub(" ", text) + " " + said)
    if ("#" in text or "@" in text) and len(_HASH.findall(text)) >= TAGS:
        text = _HASH.sub(tag, text)
    text = _NUMBER.sub("0", _plain(text.split()))
    return text, len(text) + max(0, held), marks


def _explained(line: str) -> bool:
    """Whether a link is followed by a sentence of twelve words."""
    rest = _URL.sub(" ", _MD_LINK.sub(" ", line)).strip()
    return rest[-1:] in (".", "!", "?") and len(_WORD.findall(rest)) >= 12


def _informs(lines: list[str]) -> bool:
    """Lines of a log, of a table, of code or of links that a sentence explains, whose form repeats while each tells something."""
    logged = sum(bool(_LOG.match(x)) for x in lines)
    rows = sum(bool(_ROW.match(x)) for x in lines)
    told = sum(("](" in x or "://" in x) and _explained(x) for x in lines)
    patch = any(x.startswith(("@@ ", "diff --git ")) for x in lines)
    code = sum(bool(_CODE.match(x)) or patch and x[0] in "+-" for x in lines)
    return logged >= 0.6 * len(lines) or told >= 0.6 * len(lines) or rows >= 0.6 * len(lines) or len(lines) >= 3 and code >= 0.5 * len(lines)


def _spam(block: str) -> str | None:
    """Why a block is spam -- links, tags, keywords or repetition --, or None."""
    text, length, marks = canonical(block)
    r = redundancy(text, length)
    if r >= LIST_BELOW:
        return None
    words = len(_WORD.findall(text))
    ends = len(_END.findall(_TAG.sub(" ", block) if "<" in block else block))
    density = ends / max(1, words + marks)
    if density >= FEW_ENDS:
        # Prose that is quoted twice is not spam: a sentence counts once, unless a few are all there is.
        sentences = re.split(r"(?<=[.!?])\s+", text.strip())
        once = list(dict.fromkeys(sentences))
        if len(once) < len(sentences) < 5 * len(once):
            r = redundancy(" ".join(once))
    if r >= (LIST_BELOW if density < FEW_ENDS else ANY_BELOW) or _informs([x for x in block.split("\n") if x.strip()]):
        return None
    if marks and 6 * marks >= words:
        return "tags" if text.count("#") > marks / 2 else "links"
    return "keywords" if density < FEW_ENDS else "repetition"


def _is_prose(text: str) -> bool:
    text = text.strip()
    if text[-1:] in (".", "!", "?") and 6 <= text.count(" ") < 30 and "\n" not in text:
        return True
    words = _WORD.findall(text)
    return len(words) >= 5 and len(_END.findall(text)) >= len(words) / 40


def blocks(text: str) -> list[str]:
    """Paragraphs; neighbours without sentences are put together, and long ones are cut at lines or sentences."""
    out: list[str] = []
    for part in re.split(r"\n[ \t\r]*\n", text.replace("\r\n", "\n")):
        if not part.strip():
            continue
        if out and len(out[-1]) < BLOCK and not _is_prose(out[-1]) and not _is_prose(part):
            out[-1] += "\n" + part
        else:
            out.append(part)
    cut: list[str] = []
    for part in out:
        while len(part) > BLOCK:
            at = max(part.rfind("\n", BLOCK // 2, BLOCK), part.rfind(". ", BLOCK // 2, BLOCK) + 1, part.rfind(" ", BLOCK - 200, BLOCK) if "\n" not in part[BLOCK // 2 : BLOCK] else -1)
            at = at if at > 0 else BLOCK
            cut.append(part[:at])
            part = part[at:]
        cut.append(part)
    return cut


def spam_share(text: str | None) -> tuple[float, str | None]:
    """The share of a text's characters that is spam, and the kind most of it is."""
    if not text or not text.strip():
        return 0.0, None
    total, kinds = 0, {}
    for block in blocks(text):
        size = _size(block)
        total += size
        why = _spam(block)
        if why:
            kinds[why] = kinds.get(why, 0) + size
            continue
        # A few real sentences within a list, or a list within a paragraph: score the lines that are no sentences alone.
        lines = block.split("\n") if block.count("\n") >= 2 else re.split(r"(?<=[.!?])\s+", block)
        rest = [x for x in lines if not _is_prose(x)]
        if 0 < len(rest) < len(lines):
            why = _spam("\n".join(rest))
            if why:
                kinds[why] = kinds.get(why, 0) + sum(map(_size, rest))
    if not kinds:
        return 0.0, None
    return sum(kinds.values()) / max(1, total), max(kinds, key=kinds.get)


def score_spam(documents: DataFrame) -> DataFrame:
    """``doc_id, spam_share, spam_kind`` for every row; one pass over the texts, no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [spam_share(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"].array, "spam_share": [x[0] for x in got], "spam_kind": [x[1] for x in got]})

    return spread(documents.select("doc_id", "text")).mapInPandas(run, "doc_id bigint, spam_share double, spam_kind string")


def spam_documents(documents: DataFrame, share: float = SHARE) -> DataFrame:
    """The ``doc_id`` of every document of which more than ``share`` is spam."""
    return score_spam(documents).filter(f"spam_share > {share}").select("doc_id").distinct()
