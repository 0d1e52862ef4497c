"""Scalar functions as columns.  All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column | str

# File extensions of the two indexed languages.
LANGUAGES = {"py": "python", "pyi": "python", "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "typescript", "js": "typescript", "jsx": "typescript", "mjs": "typescript", "cjs": "typescript"}
# Confidence of an edge by the way its target was found.
CONFIDENCE = {"exact": 1.0, "external": 0.9, "inferred_local": 0.9, "heuristic_unique": 0.8, "test_heuristic": 0.6, "heuristic_ambiguous": 0.5, "unresolved": 0.3}
# Weight of an edge kind in graph expansion, and what is taken for a kind not named.
EDGE_WEIGHTS = {"calls": 1.0, "inherits": 1.0, "tests": 0.9, "references": 0.7, "defines": 0.5, "imports": 0.3}
OTHER_WEIGHT = 0.5
# Shares of graph, semantic and co-change scores in a fused score.
FUSION = (0.6, 0.3, 0.1)
# Fixed value: what stands in place of a closing fence.
REDACTED = "[redacted-fence]"
# Severities from least to greatest.
SEVERITIES = ["info", "low", "medium", "high", "critical"]


def col(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def language_of(path: C) -> Column:
    """Language by the extension behind the last dot; null for others and for paths without a dot."""
    p = col(path)
    return F.when(F.instr(p, ".") > 0, literal_map(LANGUAGES)[F.lower(F.substring_index(p, ".", -1))])


def content_hash(repository: C, path: C, fqn: C, body: C) -> Column:
    """SHA-256 of the four parts with NUL between; a null fqn is the empty string."""
    return F.sha2(F.concat_ws("\x00", col(repository), col(path), F.coalesce(col(fqn), F.lit("")), col(body)), 256)


def fingerprint(path: C, line: C, category: C, source: C, rule: C, title: C) -> Column:
    """16 hex digits that stay the same over runs: where and what, not how sure or in which words."""
    named = F.coalesce(F.when(col(rule) != "", col(rule)), F.lower(col(title)))
    return F.substring(F.sha2(F.concat_ws("|", col(path), col(line).cast("string"), col(category), col(source), named), 256), 1, 16)


def prompt_key(system: C, user: C) -> Column:
    return F.substring(F.sha2(F.concat(col(system), F.lit("\x00"), col(user)), 256), 1, 32)


def idempotency_key(*parts: C) -> Column:
    return F.sha2(F.concat_ws("|", *map(col, parts)), 256)


def token_count(text: C) -> Column:
    """A quarter of the code points, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(col(text)) / 4)).cast("int")


def fqn_tail(fqn: C) -> Column:
    return F.substring_index(F.replace(col(fqn), F.lit("::"), F.lit(".")), ".", -1)


def module_fqn(path: C) -> Column:
    """Python paths dotted, without extension and package init; of others the extension is cut off."""
    p = col(path)
    py = F.regexp_replace(F.translate(F.regexp_replace(p, r"\.pyi?$", ""), "/", "."), r"(^|\.)__init__$", "")
    return F.when(language_of(p) == "python", py).otherwise(F.regexp_replace(p, r"\.(d\.ts|mts|cts|tsx|ts|jsx|mjs|cjs|js)$", ""))


def span_text(path: C, start: C, end: C) -> Column:
    s, e = col(start).cast("string"), col(end).cast("string")
    return F.when(col(start) == col(end), F.concat(col(path), F.lit(":"), s)).otherwise(F.concat(col(path), F.lit(":"), s, F.lit("-"), e))


def spans_overlap(a_start: C, a_end: C, b_start: C, b_end: C) -> Column:
    return (col(a_start) <= col(b_end)) & (col(b_start) <= col(a_end))


def severity_rank(severity: C) -> Column:
    return literal_map({s: i for i, s in enumerate(SEVERITIES)})[col(severity)]


def priority(severity: C, confidence: C) -> Column:
    return severity_rank(severity) * col(confidence)


def proximity(confidence: C, kind: C, distance: C) -> Column:
    return col(confidence) * F.coalesce(literal_map(EDGE_WEIGHTS)[col(kind)], F.lit(OTHER_WEIGHT)) / (col(distance) + 1)


def fuse(graph: C, semantic: C, co_change: C) -> Column:
    a, b, c = FUSION
    return F.lit(a) * col(graph) + F.lit(b) * col(semantic) + F.lit(c) * col(co_change)


def clamp(c: C, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col(c)))


def dot(a: C, b: C) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: C, b: C) -> Column:
    """Cosine in double precision; 0 for vectors of unequal width or without length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(col(a)) != F.size(col(b))) | (norms == 0), F.lit(0.0)).otherwise(dot(a, b) / norms)


def split_lines(text: C) -> Column:
    """Lines at CR LF or any single line end, without an empty one at the end."""
    parts = F.split(col(text), "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def normalise_body(lines: C) -> Column:
    """Lines without white space at their ends, without blank lines at either edge, joined."""
    joined = F.array_join(F.transform(col(lines), lambda x: F.regexp_replace(x, r"\s+$", "")), "\n")
    return F.regexp_replace(F.regexp_replace(joined, r"^\n+", ""), r"\n+$", "")


def identifiers(text: C) -> Column:
    """Distinct identifiers of at most 200 characters."""
    return F.filter(F.array_distinct(F.regexp_extract_all(col(text), F.lit(r"[A-Za-z_$][A-Za-z0-9_$]*"), F.lit(0))), lambda x: F.length(x) <= 200)


def title_tokens(title: C) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(col(title)), F.lit("[a-z0-9]+"), F.lit(0)))


def jaccard(a: C, b: C) -> Column:
    """0 if either side is empty."""
    both = F.size(F.array_intersect(col(a), col(b)))
    return F.when((F.size(col(a)) == 0) | (F.size(col(b)) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(col(a), col(b))))


def embedding_tokens(text: C) -> Column:
    """Lower-cased identifiers and digit runs, with their ``_`` parts and camel-case parts where there are several; a bag."""
    low = F.regexp_extract_all(F.lower(col(text)), F.lit(r"[a-z_][a-z0-9_]*|[0-9]+"), F.lit(0))
    whole = F.regexp_extract_all(col(text), F.lit(r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+"), F.lit(0))
    parts = F.flatten(F.transform(low, lambda w: F.filter(F.split(w, "_"), lambda x: x != "")))
    several = F.flatten(F.transform(low, lambda w: F.when(F.size(F.filter(F.split(w, "_"), lambda x: x != "")) > 1, F.filter(F.split(w, "_"), lambda x: x != "")).otherwise(F.array().cast("array<string>"))))
    # an upper-case run gives its last letter to a word that follows: put a mark between, then split
    def camel(w: Column) -> Column:
        marked = F.regexp_replace(F.regexp_replace(w, r"([A-Z]+)([A-Z][a-z])", "$1 $2"), r"([a-z])([A-Z])", "$1 $2")
        return F.transform(F.regexp_extract_all(marked, F.lit(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+"), F.lit(0)), F.lower)

    humps = F.flatten(F.transform(whole, lambda w: F.when(F.size(camel(w)) > 1, camel(w)).otherwise(F.array().cast("array<string>"))))
    return F.concat(low, several, humps)


def neutralise_fences(text: C, tags: tuple[str, ...] = ("untrusted-diff", "untrusted-context")) -> Column:
    """Closing tags of the named fences made harmless, in any case."""
    return F.regexp_replace(col(text), f"(?i)</\\s*({'|'.join(tags)})\\s*>", REDACTED)


def path_is_safe(path: C) -> Column:
    """Relative, no parent segments, no NUL, 1 to 1,024 characters."""
    p = col(path)
    return F.coalesce((F.length(p).between(1, 1024)) & ~p.startswith("/") & ~p.rlike(r"(^|/|\\)\.\.(/|\\|$)") & (F.instr(p, "\x00") == 0), F.lit(False))
