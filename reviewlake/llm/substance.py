"""Whether a documentation comment says anything."""

from __future__ import annotations

import re

# Phrases of placeholders and reminders, tool directives and pointers elsewhere.
_REMINDER = re.compile(r"^\W*((doc(string|umentation)?|comment|text|description)\s+(goes|comes)\s+here|todo|fixme|xxx|hack|tbd|tba|wip|n/?a|none|undocumented|placeholder|lorem\s+ipsum|foo|bar|test|description|summary|_summary_|_description_|documentation|docstring|write\s+me|fill\s+(me\s+)?in|to\s+be\s+(written|done|documented|completed|added)|(missing|no|add|needs|insert)\s+(a\s+)?(doc(s|string|umentation)?|description|comment)s?(\s+(yet|here|available|provided))?|(auto[\s-]?generated)\b.*(stub|comment|javadoc|docstring)|document\s+(this|me)|not\s+(yet\s+)?(documented|implemented|written)(\s+yet)?|coming\s+soon)\b\W*", re.I)
_REMINDER_LINE = re.compile(r"^\W*(todo|fixme|xxx|hack|tbd)\b", re.I)
_DIRECTIVE = re.compile(r"^\W*(noqa|nosec|type:\s*ignore|pylint\s*:|mypy\s*:|flake8\s*:|ruff\s*:|pragma\s*:|fmt\s*:|isort\s*:|yapf\s*:|pyright\s*:|eslint[\w-]*|tslint[\w:-]*|jshint\b|jslint\b|jscs\b|prettier-ignore|istanbul\b|c8\s+ignore|v8\s+ignore|@?ts-(ignore|nocheck|expect-error|check)|stylelint[\w-]*|biome-ignore|deno-lint[\w-]*|webpack\w+\s*:|@__?pure__?|#__pure__|coverage\s*:|cspell\s*:|spell-?checker\s*:|nolint|global\s+\w+)", re.I)
_POINTER = re.compile(r"^\W*(see|same\s+as|refer\s+to|cf\.?|as\s+(above|below|before)|ditto|like\s+(above|below)|idem|inherit(s|ed)?(\s+(doc\w*|from\b.*))?|inheritdoc|overrid(es|den|e)(\s+(from|of|in)?\b.*)?|implements\s+\S+|delegates?\s+to|alias\s+(of|for)|copied\s+from|documented\s+(in|at|elsewhere)|@see|@inheritdoc|@override|look\s+at|check\s+the\s+(docs?|wiki|base))\b", re.I)
_TAG = re.compile(r"^\s*(@\w+|:\w+(\s+[^:\n]*)?:|\.\.\s+\w+::|(args|arguments|parameters|params|returns?|yields?|raises|throws|attributes|keyword\s+args|other\s+parameters|example|examples|notes?|see\s+also|references|warnings?)\s*:?\s*$|(args|arguments|returns?|raises|yields)\s*:)", re.I)
_EXAMPLE = re.compile(r"^\s*(@example\b|examples?\s*:?:?\s*$|>>>|\.\.\s+code)", re.I)
# Words that add nothing to a name.
STOP = frozenset("a an the this that these those it its is are be was of to for from in on at by with and or as function method class constructor helper module routine procedure func fn def used use uses using which will can does do did given new value values property getter setter implementation implement method's function's le la les un une der die das ein eine el los las".split())


def _words(text: str) -> list[str]:
    return [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_a-zA-Z]+[^\W\d_]*", text)]


def stem(word: str) -> str:
    """A word without its ending, enough to match a verb with its forms."""
    for end, put in (("ies", "y"), ("ied", "y"), ("ying", "y"), ("sses", "ss"), ("ches", "ch"), ("shes", "sh"), ("xes", "x"), ("ing", ""), ("ed", ""), ("es", ""), ("s", ""), ("e", "")):
        if word.endswith(end) and len(word) - len(end) >= 2:
            word = word[: len(word) - len(end)] + put
            break
    if len(word) > 3 and word[-1] == word[-2]:
        word = word[:-1]
    return word[:-1] if word.endswith("e") and len(word) > 3 else word


def clean(doc: str) -> str:
    """The text without comment borders."""
    return "\n".join(re.sub(r"^\s*\*+(?!\*)\s?", "", x).rstrip() for x in doc.replace("\r", "").split("\n")).strip()


def description(doc: str) -> str:
    """What stands before the first tag, section or example, without reminders."""
    out = []
    for line in clean(doc).split("\n"):
        if _TAG.match(line) or _EXAMPLE.match(line):
            break
        if not _REMINDER_LINE.match(line):
            out.append(line)
    return " ".join(" ".join(out).split())


def _says(text: str, name: str, least: int = 1) -> bool:
    text = re.sub(r"\{@\w+[^}]*\}|@inheritdoc\b", " ", text, flags=re.I).strip()
    text = re.sub(r"https?://\S+", " ", text).strip()
    if not re.search(r"[^\W\d_]", text) or _DIRECTIVE.match(text):
        return False
    # a reminder or a pointer alone; one that is followed by a sentence of its own is documentation
    rest = text
    for _ in range(4):
        first = re.match(r"[^.!?]*[.!?]*\s*", rest)[0]
        m = _REMINDER.match(rest)
        if m and (m.end() >= len(rest) or _REMINDER_LINE.match(rest)):
            rest = rest[max(len(first), 1):] if not _REMINDER_LINE.match(rest) else ""
        elif m and m.end() >= len(first):
            rest = rest[m.end():]
        elif _POINTER.match(rest) and first:
            rest = rest[len(first):]
        else:
            break
        if not rest.strip():
            return False
    named = {stem(w) for w in _words(name.strip("_"))} | {w for w in _words(name)}
    if name.lower() in ("constructor", "__init__", "__new__"):
        named |= {stem(w) for w in ("init", "initialise", "initialize", "initializer", "constructor", "construct", "instance", "create")}
    said = [w for w in _words(rest) if w not in STOP]
    return sum(stem(w) not in named and w not in named for w in said) >= least


def has_substance(doc: str | None, name: str) -> bool:
    """False for documentation that is blank or symbols only, a placeholder or reminder, bare tags or parameter names, a
    tool directive, a mere pointer elsewhere, or only restates the name."""
    if not doc or not doc.strip():
        return False
    if _says(description(doc), name):
        return True
    # What tags say counts if it is more than names: at least three words of a description.
    if _REMINDER_LINE.match(clean(doc)):
        return False
    tagged, inside, example = [], False, False
    for line in clean(doc).split("\n"):
        if _EXAMPLE.match(line):
            example = True
            continue
        m = _TAG.match(line)
        if m:
            inside, example = True, False
            line = line[m.end():]
            if re.match(r"\s*@(param|arg|argument|property|prop|template|typeparam|throws|see|type|returns?)\b", m[0], re.I):
                line = re.sub(r"^\s*(\{[^}]*\}\s*)?[\w$.\[\]=]*\s*-?\s*" if re.match(r"\s*@(param|arg|argument|property|prop|template|typeparam)", m[0], re.I) else r"^\s*(\{[^}]*\})?\s*", "", line)
            if re.match(r"\s*@(see|link|author|since|version|module|memberof|name|license|copyright)\b", m[0], re.I):
                continue
        if inside and not example and not _REMINDER_LINE.match(line):
            tagged.append(re.sub(r"^\s*\*{0,2}\w+\s*(\([^)]*\))?\s*:\s*", " ", line))
    return any(_says(x, name, 3) for x in tagged)
