"""Resolving references to symbols, as joins over whole relations.

Relations, all within ``scope`` (a repository):

* ``modules``: module, path, language
* ``symbols``: module, symbol_id (the order of definition), fqn, name, kind, parent_fqn
* ``imports``: module (that imports), ordinal, local_name (``*`` for all names), spec, imported_symbol (null: the module
  itself), is_relative, level
* ``refs``: ref_id, module, kind, from_fqn, target_name, receiver, receiver_type

An outcome is ``dst_fqn, dst_unresolved_name, confidence, rule``: nothing is dropped, what is not found keeps its name.  Each
look-up table has one row a key, so no join multiplies references, however often a name occurs.

Defined results: empty relations give empty results; of definitions or imports of one name in a module the last holds; nulls
in a key match nothing; rows of other scopes are never seen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import cut
from .graph import candidates, heuristic, members

STAR, HOPS = "*", 5
Scope = Sequence[str]


def _normal(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments; what climbs above the root keeps its ``..``."""
    def step(acc, x):
        up = (x == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("..")) != "..")
        return F.when(x.isin("", "."), acc).when(up, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.expr("cast(array() as array<string>)"), step), "/")


def import_targets(imports: DataFrame, modules: DataFrame, scope: Scope = ("repository_id",)) -> DataFrame:
    """Adds ``base`` (the module an import names, null if it cannot be one of the repository) and ``is_known``.

    Python: dotted names, relative ones from the package, which a package's ``__init__`` itself is.  Others: relative paths,
    of a file or of a folder's index; bare names are packages.
    """
    own = modules.groupBy(*scope, "module").agg(F.max("path").alias("path"), F.max("language").alias("language"))
    i = imports.join(own, [*scope, "module"])
    parts, strip = F.split("module", r"\."), F.col("level") - F.col("path").endswith("__init__.py").cast("int")
    package = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - strip, F.lit(0))), ".")
    relative = F.when((strip < F.size(parts)) & (F.col("spec") == ""), package).when(strip < F.size(parts), F.concat_ws(".", package, "spec"))
    python = F.when(F.col("is_relative"), relative).otherwise(F.col("spec"))
    file = F.when(F.col("is_relative"), _normal(F.concat_ws("/", F.regexp_extract("path", r"^(.*)/[^/]*$", 1), "spec")))
    i = i.withColumns({"first": F.when(F.col("language") == "python", python).otherwise(file), "second": F.when(F.col("language") != "python", F.concat(file, F.lit("/index")))})
    for name in ("first", "second"):
        i = i.join(own.select(*scope, F.col("module").alias(name), F.lit(True).alias(f"has_{name}")), [*scope, name], "left")
    base = F.when(F.col("has_first"), F.col("first")).when(F.col("has_second"), F.col("second")).when(F.col("language") == "python", F.col("first"))
    known = F.coalesce("has_first", "has_second", F.lit(False))
    return i.select(*imports.columns, "language", base.alias("base"), known.alias("is_known"))


def top_level(symbols: DataFrame, scope: Scope = ("repository_id",)) -> DataFrame:
    """``module, name, t_dst``: the last top-level definition of each name."""
    return symbols.filter("parent_fqn is null and kind <> 'module'").groupBy(*scope, "module", "name").agg(F.max_by("fqn", "symbol_id").alias("t_dst"))


def follow_names(asked: DataFrame, targets: DataFrame, modules: DataFrame, tops: DataFrame, hops: int = HOPS, scope: Scope = ("repository_id",)) -> DataFrame:
    """``module, name, dst_fqn`` of names that a module passes on from others, over at most ``hops`` imports.

    ``asked``: module, name; ``targets``: as from ``import_targets``.  An import of the name comes before imports of all names,
    those in their order, each with what lies behind it before the next: the way walked, as text, is that order.
    """
    named = targets.filter(F.col("local_name") != STAR).groupBy(*scope, F.col("module").alias("at"), F.col("local_name").alias("name")).agg(F.max_by(F.struct("imported_symbol", "base", "is_known"), "ordinal").alias("i"))
    named = named.select(*scope, "at", "name", "i.*", F.lit("000000").alias("turn"))
    stars = targets.filter((F.col("local_name") == STAR) & F.col("is_known")).select(*scope, F.col("module").alias("at"), "base", F.format_string("1%05d", F.col("ordinal").cast("int")).alias("turn"))
    known = modules.select(*scope, F.col("module").alias("sub")).distinct().withColumn("is_sub", F.lit(True))
    walk = asked.select(*scope, "module", F.col("name").alias("wanted"), F.col("module").alias("at"), "name", F.lit("").alias("way")).distinct()
    hits = None
    for _ in range(hops):
        a = walk.join(named, [*scope, "at", "name"]).select(*scope, "module", "wanted", F.concat("way", "turn").alias("way"), "base", F.col("imported_symbol").alias("name"), "is_known", F.lit(False).alias("by_star"))
        b = walk.join(stars, [*scope, "at"]).select(*scope, "module", "wanted", F.concat("way", "turn").alias("way"), "base", "name", F.lit(True).alias("is_known"), F.lit(True).alias("by_star"))
        step = a.unionByName(b).filter("base is not null")
        step = step.join(tops.withColumnRenamed("module", "base"), [*scope, "base", "name"], "left").withColumn("sub", F.when(~F.col("by_star"), F.concat_ws(".", "base", "name"))).join(known, [*scope, "sub"], "left")
        whole = F.col("name").isNull()
        dst = F.when(whole & F.col("is_known"), F.col("base")).when(~whole, F.coalesce("t_dst", F.when(F.col("is_sub"), F.col("sub"))))
        step = cut(step.select(*scope, "module", "wanted", "way", F.col("base").alias("at"), "name", dst.alias("dst"), (~whole & F.col("is_known")).alias("goes_on")))
        got = step.filter("dst is not null").select(*scope, "module", "wanted", "way", "dst")
        hits = got if hits is None else hits.unionByName(got)
        walk = step.filter("dst is null and goes_on").select(*scope, "module", "wanted", "at", "name", "way")
    return hits.groupBy(*scope, "module", F.col("wanted").alias("name")).agg(F.min_by("dst", "way").alias("dst_fqn"))


def bindings(imports: DataFrame, modules: DataFrame, symbols: DataFrame, scope: Scope = ("repository_id",)) -> DataFrame:
    """Every import with what it binds: ``dst_fqn, dst_unresolved_name, confidence, rule``, and ``base, is_known``.

    A module of the repository; a top-level symbol of one; a submodule; a name that the module passes on; else a known
    module without such a name is unresolved, and anything beyond is external.
    """
    c = S.CONFIDENCE
    targets = cut(import_targets(imports, modules, scope))
    tops = top_level(symbols, scope)
    known = modules.select(*scope, F.col("module").alias("sub")).distinct().withColumn("is_sub", F.lit(True))
    r = targets.withColumn("sub", F.concat_ws(".", "base", "imported_symbol")).join(tops.withColumnsRenamed({"module": "base", "name": "imported_symbol"}), [*scope, "base", "imported_symbol"], "left").join(known, [*scope, "sub"], "left")
    whole = F.col("imported_symbol").isNull()
    rule = F.when(whole & F.col("is_known"), "module").when(whole | F.col("base").isNull(), "external").when(F.col("t_dst").isNotNull(), "symbol").when(F.col("is_sub"), "submodule").when(F.col("is_known"), "unknown").otherwise("external")
    r = cut(r.withColumn("rule", rule))
    open_ = r.filter("rule = 'unknown'").select(*scope, F.col("base").alias("module"), F.col("imported_symbol").alias("name"))
    passed = follow_names(open_, targets, modules, tops, scope=scope).select(*scope, F.col("module").alias("base"), F.col("name").alias("imported_symbol"), F.col("dst_fqn").alias("p_dst"))
    r = r.join(passed, [*scope, "base", "imported_symbol"], "left").withColumn("rule", F.when((F.col("rule") == "unknown") & F.col("p_dst").isNotNull(), "passed on").otherwise(F.col("rule")))
    k = F.col("rule")
    dst = F.when(k == "module", F.col("base")).when(k == "symbol", F.col("t_dst")).when(k == "submodule", F.col("sub")).when(k == "passed on", F.col("p_dst"))
    name = F.concat_ws(".", F.when(F.col("spec") != "", F.col("spec")), "imported_symbol")
    return r.select(*imports.columns, "base", "is_known", dst.alias("dst_fqn"), F.when(dst.isNull(), name).alias("dst_unresolved_name"),
                    F.when(dst.isNotNull(), c["exact"]).when(k == "unknown", c["unresolved"]).otherwise(c["external"]).alias("confidence"), "rule")


def known_names(bound: DataFrame, symbols: DataFrame, scope: Scope = ("repository_id",)) -> DataFrame:
    """``module, name`` with what a module knows it by: ``bound`` (the last import's outcome), ``alias`` (the module of the
    repository it stands for), ``outside`` (stands for a module beyond it), ``t_dst`` (its own top-level symbol)."""
    outcome = F.struct("dst_fqn", "dst_unresolved_name", "confidence")
    last = bound.filter(F.col("local_name") != STAR).groupBy(*scope, "module", F.col("local_name").alias("name")).agg(F.max_by(F.struct(outcome.alias("bound"), "imported_symbol", "base", "is_known"), "ordinal").alias("i"))
    whole = F.col("i.imported_symbol").isNull()
    last = last.select(*scope, "module", "name", "i.bound", F.when(whole & F.col("i.is_known"), F.col("i.base")).alias("alias"), (whole & ~F.col("i.is_known")).alias("outside"))
    return last.join(top_level(symbols, scope), [*scope, "module", "name"], "full")


def resolve_uses(refs: DataFrame, names: DataFrame, symbols: DataFrame, inherited: DataFrame | None = None, scope: Scope = ("repository_id",)) -> DataFrame:
    """References with their outcome, by the first rule that applies.

    ``self``: a member of the class around it or of its bases; ``typed``: a member of the class its receiver was made from;
    ``alias``: a top-level symbol of the module its receiver stands for; ``external``: its receiver leads out of the
    repository; ``import`` and ``module``: what a bare name is in its module; ``name``: symbols of that name, methods first
    behind a receiver, those of the class around it left out behind an attribute of ``self``.  A test's target is a bare
    name, at the confidence of tests.
    """
    c = S.CONFIDENCE
    around = symbols.groupBy(*scope, F.col("fqn").alias("from_fqn")).agg(F.max_by(F.struct("kind", "parent_fqn"), "symbol_id").alias("s"))
    around = around.select(*scope, "from_fqn", F.when(F.col("s.kind") == "class", F.col("from_fqn")).when(F.col("s.kind") == "method", F.col("s.parent_fqn")).alias("owner"))
    r = refs.select(*scope, "ref_id", "module", "kind", "from_fqn", "target_name", "receiver", "receiver_type").join(around, [*scope, "from_fqn"], "left")
    test, receiver = F.col("kind") == "tests", F.col("receiver")
    root = F.substring_index("receiver", ".", 1)
    mine = ~test & F.coalesce(receiver.isin("self", "this", "cls"), F.lit(False))
    bare = test | receiver.isNull()
    hidden = F.when(~bare & ~mine & root.isin("self", "this", "cls"), F.col("owner"))
    r = r.withColumns({"root": F.when(~bare & ~mine, root), "through": F.when(~bare & ~mine, receiver), "made_from": F.when(~bare & ~mine, F.col("receiver_type")), "prefer_methods": ~bare, "exclude_owner": hidden})
    r = heuristic(r, symbols, scope).withColumnsRenamed({"dst_fqn": "h_dst", "dst_unresolved_name": "h_un", "confidence": "h_conf"})
    look = lambda key, take: names.select(*scope, "module", F.col("name").alias(key), *take)
    r = r.join(look("target_name", ["bound", "t_dst"]), [*scope, "module", "target_name"], "left")
    r = r.join(look("through", [F.col("alias").alias("a_module"), F.col("outside").alias("a_out"), F.lit(True).alias("a_any")]), [*scope, "module", "through"], "left")
    r = r.join(look("root", [F.col("outside").alias("r_out")]), [*scope, "module", "root"], "left")
    r = r.join(top_level(symbols, scope).select(*scope, F.col("module").alias("a_module"), F.col("name").alias("target_name"), F.col("t_dst").alias("a_dst")), [*scope, "a_module", "target_name"], "left")
    if inherited is not None:
        made = r.filter("made_from is not null").select(*scope, "module", "made_from").distinct()
        made = made.join(look("made_from", ["bound", "t_dst"]), [*scope, "module", "made_from"], "left").join(candidates(symbols, scope).select(*scope, F.col("name").alias("made_from"), "f"), [*scope, "made_from"], "left")
        made = made.withColumn("fqn", F.when(F.col("bound").isNotNull(), F.col("bound.dst_fqn")).otherwise(F.coalesce("t_dst", "f")))
        classes = around.filter("owner = from_fqn").select(*scope, F.col("owner").alias("fqn"))
        made = made.join(classes, [*scope, "fqn"], "left_semi").select(*scope, "module", "made_from", F.col("fqn").alias("class"))
        r = r.join(made, [*scope, "module", "made_from"], "left").withColumn("in_class", F.when(mine, F.col("owner")).otherwise(F.col("class")))
        r = r.join(inherited.select(*scope, F.col("owner").alias("in_class"), F.col("name").alias("target_name"), F.col("dst_fqn").alias("m_dst")), [*scope, "in_class", "target_name"], "left")
    else:
        r = r.withColumn("m_dst", F.lit(None).cast("string"))
    own = mine & F.col("m_dst").isNotNull()
    typed = ~mine & ~bare & F.col("m_dst").isNotNull()
    alias = ~mine & ~bare & F.col("a_module").isNotNull()
    out = ~mine & ~bare & (F.coalesce("a_out", F.lit(False)) | F.coalesce("r_out", F.lit(False)))
    rule = F.when(own, "self").when(typed, "typed").when(alias, "alias").when(out, "external").when(bare & F.col("bound").isNotNull(), "import").when(bare & F.col("t_dst").isNotNull(), "module").otherwise("name")
    r = r.withColumn("rule", rule)
    k = F.col("rule")
    dst = F.when(k.isin("self", "typed"), F.col("m_dst")).when(k == "alias", F.col("a_dst")).when(k == "external", None).when(k == "import", F.col("bound.dst_fqn")).when(k == "module", F.col("t_dst")).otherwise(F.col("h_dst"))
    un = F.when(k == "alias", F.concat_ws(".", "a_module", "target_name")).when(k == "external", F.concat_ws(".", "receiver", "target_name")).when(k == "import", F.col("bound.dst_unresolved_name")).otherwise(F.col("h_un"))
    conf = F.when(k.isin("self", "module"), c["exact"]).when(k == "typed", c["inferred_local"]).when(k == "alias", F.when(dst.isNotNull(), c["exact"]).otherwise(c["unresolved"])).when(k == "external", c["external"]).when(k == "import", F.col("bound.confidence")).otherwise(F.col("h_conf"))
    conf = F.when(test, F.when(dst.isNotNull(), c["test_heuristic"]).otherwise(c["unresolved"])).otherwise(conf)
    un = F.when(dst.isNull(), F.when(test, F.col("target_name")).otherwise(un))
    return r.select(*scope, "ref_id", "module", "kind", "from_fqn", "target_name", dst.alias("dst_fqn"), un.alias("dst_unresolved_name"), conf.alias("confidence"), "rule")


def resolve(refs: DataFrame, imports: DataFrame, modules: DataFrame, symbols: DataFrame, scope: Scope = ("repository_id",)) -> DataFrame:
    """Every reference with its outcome; base classes are resolved first, so that members are found where they are inherited.

    Names and base classes are written to the checkpoint folder, as several joins read them.
    """
    names = cut(known_names(bindings(imports, modules, symbols, scope), symbols, scope))
    heads = resolve_uses(refs.filter("kind = 'inherits'"), names, symbols, None, scope).filter("dst_fqn is not null")
    bases = heads.select(*scope, F.col("from_fqn").alias("owner"), F.col("dst_fqn").alias("base"), F.col("ref_id").alias("ordinal"))
    inherited = members(symbols, bases.groupBy(*scope, "owner", "base").agg(F.min("ordinal").alias("ordinal")), scope=scope)
    return resolve_uses(refs, names, symbols, inherited, scope)


def edges(resolved: DataFrame, bound: DataFrame | None = None, scope: Scope = ("repository_id",)) -> DataFrame:
    """``kind, src_fqn, dst_fqn, dst_unresolved_name, confidence`` of references and of imports, each once with its greatest
    confidence."""
    e = resolved.select(*scope, "kind", F.col("from_fqn").alias("src_fqn"), "dst_fqn", "dst_unresolved_name", "confidence")
    if bound is not None:
        e = e.unionByName(bound.select(*scope, F.lit("imports").alias("kind"), F.col("module").alias("src_fqn"), "dst_fqn", "dst_unresolved_name", "confidence"))
    return e.groupBy(*scope, "kind", "src_fqn", "dst_fqn", "dst_unresolved_name").agg(F.max("confidence").alias("confidence"))


def from_parsed(parsed: DataFrame, scope: Scope = ("repository_id",)) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(refs, imports, modules, symbols) of parsed files: scope, file_id, path, module_fqn, symbols, imports, refs."""
    at = (F.col("file_id").cast("bigint") * (1 << 20)) + F.col("pos")
    key = [*scope, F.col("module_fqn").alias("module")]
    language = F.when(F.col("path").rlike(r"\.pyi?$"), "python").otherwise("typescript")
    modules = parsed.select(*key, "path", language.alias("language"))
    symbols = parsed.select(*key, "file_id", F.posexplode("symbols").alias("pos", "s")).select(*scope, "module", at.alias("symbol_id"), "s.*")
    imports = parsed.select(*key, "file_id", F.posexplode("imports").alias("pos", "i")).select(*scope, "module", F.col("pos").alias("ordinal"), "i.local_name", F.col("i.module").alias("spec"), "i.imported_symbol", "i.is_relative", "i.level")
    refs = parsed.select(*key, "file_id", F.posexplode("refs").alias("pos", "r")).select(*scope, at.alias("ref_id"), "module", "r.kind", "r.from_fqn", "r.target_name", "r.receiver", "r.receiver_type")
    return refs, imports, modules, symbols
