"""Which files enter the index: two phases, the first on path and size alone so that excluded content is never read."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import col, language_of

MAX_BYTES, MEAN_LINE, SNIFF = 1_000_000, 200, 4096
# Path segments of vendored or build trees, suffixes and markers of generated and minified files, test folders.
VENDORED = "node_modules bower_components jspm_packages vendor third_party site-packages dist build out target .venv venv .tox .nox .git __pycache__ .mypy_cache .pytest_cache .ruff_cache .cache .next .nuxt .svelte-kit coverage htmlcov .gradle .idea".split()
GENERATED_SUFFIXES = "_pb2.py _pb2_grpc.py .pb.ts .pb.js .gen.ts .gen.js .generated.ts .generated.js .d.ts".split()
MINIFIED_SUFFIXES = ".min.js .min.css .min.mjs".split()
GENERATED_MARKERS = ["@generated", "DO NOT EDIT", "DO NOT MODIFY", "Code generated by", "AUTO-GENERATED", "autogenerated by"]
TEST_FOLDERS = ["tests", "test", "__tests__"]


def _ends(path: Column, suffixes: list[str]) -> Column:
    return path.rlike("(" + "|".join(map(re.escape, suffixes)) + ")$")


def gitignore_rules(lines: list[str]) -> list[tuple[str, bool]]:
    """(pattern as a Java regular expression, whether it excludes) of each rule, in order."""
    out = []
    for line in lines:
        line = line.rstrip("\n\r")
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        keep = line.startswith("!")
        line = line[1:] if keep else line
        line = line[1:] if line.startswith("\\") else line
        folder, line = line.endswith("/"), line.rstrip("/")
        rooted = "/" in line
        line = line.lstrip("/")
        rx, i = "", 0
        while i < len(line):
            if line.startswith("**/", i):
                rx, i = rx + "(?:.*/)?", i + 3
            elif line.startswith("/**", i) and i + 3 == len(line):
                rx, i = rx + "/.+", i + 3
            elif line[i] == "*":
                rx, i = rx + "[^/]*", i + 1
            elif line[i] == "?":
                rx, i = rx + "[^/]", i + 1
            elif line[i] == "[" and "]" in line[i + 2 :]:
                end = line.index("]", i + 2)
                inner = line[i + 1 : end]
                rx, i = rx + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end + 1
            else:
                if line[i] == "\\" and i + 1 < len(line):
                    i += 1
                rx, i = rx + re.sub(r"([\\.^$|()\[\]{}*+?])", r"\\\1", line[i]), i + 1
        out.append((("^" if rooted else "(?:^|.*/)") + rx + ("/.*$" if folder else "(?:/.*)?$"), not keep))
    return out


def gitignored(path: Column | str, rules: list[tuple[str, bool]]) -> Column:
    """The last rule that matches decides."""
    out = F.lit(False)
    for pattern, excludes in rules:
        out = F.when(col(path).rlike(pattern), F.lit(excludes)).otherwise(out)
    return out


def path_exclusion(path: Column | str, size: Column | str, rules: list[tuple[str, bool]] = ()) -> Column:
    p = col(path)
    return (F.when(language_of(p).isNull(), "unsupported_language").when(F.arrays_overlap(F.split(p, "/"), F.array(*map(F.lit, VENDORED))), "vendored")
            .when(gitignored(p, rules), "gitignored").when(col(size) > MAX_BYTES, "too_large").otherwise("none"))


def is_minified(path: Column | str, content: Column | str) -> Column:
    p, c = col(path), col(content)
    lines = F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + 1
    return _ends(p, MINIFIED_SUFFIXES) | ((F.octet_length(c) > 0) & (F.octet_length(c) / lines > MEAN_LINE))


def is_generated(path: Column | str, content: Column | str) -> Column:
    head = F.substring(col(content), 1, SNIFF)
    marked = F.lit(False)
    for m in GENERATED_MARKERS:
        marked = marked | head.contains(m)
    return _ends(col(path), GENERATED_SUFFIXES) | marked


def is_test(path: Column | str) -> Column:
    """By folder (never the file's own name), by a stem of test_* or *_test, or by .test or .spec in the name."""
    segments = F.split(col(path), "/")
    name = F.element_at(segments, -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    folders = F.slice(segments, 1, F.size(segments) - 1)
    return F.arrays_overlap(folders, F.array(*map(F.lit, TEST_FOLDERS))) | stem.startswith("test_") | stem.endswith("_test") | F.contains(name, F.lit(".test")) | F.contains(name, F.lit(".spec"))


def decide(files: DataFrame, rules: list[tuple[str, bool]] = (), index_generated: bool = False) -> DataFrame:
    """Adds ``exclusion, included, file_language, in_test, generated`` to ``path, size_bytes, content``.

    Null content counts as empty; a null path is unsupported.  One pass, no shuffle.
    """
    c = F.coalesce(F.col("content"), F.lit(""))
    first = path_exclusion("path", "size_bytes", rules)
    hard = _ends(F.col("path"), GENERATED_SUFFIXES)
    generated = is_generated("path", c)
    drop = generated & (hard | F.lit(not index_generated))
    second = F.when(first != "none", first).when(F.instr(F.substring(c, 1, SNIFF), "\x00") > 0, "binary").when(is_minified("path", c), "minified").when(drop, "generated").otherwise("none")
    out = files.withColumn("exclusion", second)
    kept = F.col("exclusion") == "none"
    return out.withColumns({"included": kept, "file_language": language_of("path"), "in_test": kept & is_test("path"), "generated": (kept & generated) | (F.col("exclusion") == "generated")})


def exclusion_counts(decided: DataFrame) -> DataFrame:
    return decided.groupBy("exclusion").agg(F.count("*").alias("files"))
