"""Queries of the resolver.

The supplied tables hold symbols but neither imports nor references, so both are derived from the symbols, the same way in
both languages: every module imports from the modules that follow it in its repository, by name, as a module, with all names,
over several hops and from outside, and every symbol refers to others in each way that a rule is for.  ``resolve_parsed`` takes
imports and references from the parsers instead and has no SQL.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import graph as G
from ..operators import parsing
from ..operators import resolution as X
from ..session import cut
from . import relations as R
from .files import LANG_SQL
from .registry import query

MISSING = "zz_missing"


def modules(spark, d):
    """Modules with their number within the repository."""
    m = R.files(spark, d).select("repository_id", S.module_fqn("path").alias("module"), "path", F.when(S.language_of("path") == "python", "python").otherwise("typescript").alias("language"))
    m = m.groupBy("repository_id", "module").agg(F.min_by("language", "path").alias("language"), F.min("path").alias("path"))
    return m.withColumns({"no": F.row_number().over(Window.partitionBy("repository_id").orderBy("module")) - 1, "many": F.count("*").over(Window.partitionBy("repository_id"))})


def symbols(spark, d):
    return R.symbols(spark, d).select("repository_id", S.module_fqn("path").alias("module"), "symbol_id", "fqn", "name", "kind", "parent_fqn")


_MODULE = f"case when {LANG_SQL} = 'python' then regexp_replace(replace(regexp_replace(path, '\\.pyi?$', ''), '/', '.'), '(^|\\.)__init__$', '') else regexp_replace(path, '\\.(d\\.ts|mts|cts|tsx|ts|jsx|mjs|cjs|js)$', '') end"
MODULES = R.SYMBOLS + f""", mod as (select *, row_number() over (partition by repository_id order by module) - 1 no, count(*) over (partition by repository_id) many from (
  select repository_id, {_MODULE} module, arg_min(case when {LANG_SQL} = 'python' then 'python' else 'typescript' end, path) lang, min(path) path from src group by all)),
ysm as (select repository_id, {_MODULE} module, symbol_id, fqn, name, kind, parent_fqn from sym),
tops as (select repository_id, module, name, arg_max(fqn, symbol_id) dst from ysm where parent_fqn is null and kind <> 'module' group by all),
fst as (select repository_id, module, min(name) name from tops group by all)"""


def _after(m, k):
    """Every module with the one ``k`` places on in its repository and the least of its top-level names."""
    return m.select("repository_id", "module", ((F.col("no") + k) % F.col("many")).alias("no")).join(m.select("repository_id", "no", F.col("module").alias(f"m{k}")), ["repository_id", "no"]).drop("no")


def imports(m, s):
    first = X.top_level(s).groupBy("repository_id", "module").agg(F.min("name").alias("name"))
    a = m.join(_after(m, 1), ["repository_id", "module"]).join(_after(m, 3), ["repository_id", "module"])
    a = a.join(first.select("repository_id", F.col("module").alias("m1"), F.col("name").alias("n1")), ["repository_id", "m1"], "left").join(first.select("repository_id", F.col("module").alias("m3"), F.col("name").alias("n3")), ["repository_id", "m3"], "left")
    python = F.col("language") == "python"
    spec = F.when(python, F.col("m1")).otherwise(F.concat(F.expr("repeat('../', size(split(path, '/')) - 1)"), "m1"))
    none, inside = F.lit(None).cast("string"), ~python
    row = lambda no, local, sp, sym, rel: F.struct(F.lit(no).alias("ordinal"), local.alias("local_name"), sp.alias("spec"), sym.alias("imported_symbol"), rel.alias("is_relative"))
    rows = F.array(row(1, F.lit("*"), spec, none, inside), row(2, F.lit("ext"), F.lit("os"), none, F.lit(False)), row(3, F.lit("lib"), spec, none, inside), row(4, F.col("n1"), spec, F.col("n1"), inside), row(5, F.col("n3"), spec, F.col("n3"), inside), row(6, F.lit(MISSING), spec, F.lit(MISSING), inside))
    return a.select("repository_id", "module", F.explode(rows).alias("i")).select("repository_id", "module", "i.*", F.lit(0).alias("level")).filter("local_name is not null")


IMPORTS = MODULES + f""", nxt as (select a.repository_id, a.module, a.lang, m1.module m1, m3.module m3, f1.name n1, f3.name n3 from mod a join mod m1 on m1.repository_id = a.repository_id and m1.no = (a.no + 1) % a.many join mod m3 on m3.repository_id = a.repository_id and m3.no = (a.no + 3) % a.many
  left join fst f1 on f1.repository_id = a.repository_id and f1.module = m1.module left join fst f3 on f3.repository_id = a.repository_id and f3.module = m3.module),
imp as (select * from (select repository_id, module, 1 ordinal, '*' local_name, m1 base, null::varchar imported from nxt union all select repository_id, module, 2, 'ext', null, null from nxt union all select repository_id, module, 3, 'lib', m1, null from nxt
  union all select repository_id, module, 4, n1, m1, n1 from nxt union all select repository_id, module, 5, n3, m1, n3 from nxt union all select repository_id, module, 6, '{MISSING}', m1, '{MISSING}' from nxt) where local_name is not null),
lnk as (select repository_id, module as at, local_name as name, arg_max(base, ordinal) base, arg_max(coalesce(imported, ''), ordinal) imported, false star from imp where local_name <> '*' group by all union all select repository_id, module, null, base, null, true from imp where local_name = '*'),
ask as (select distinct i.repository_id, i.base m0, i.imported n0 from imp i where i.imported is not null and not exists (select 1 from tops t where t.repository_id = i.repository_id and t.module = i.base and t.name = i.imported) and not exists (select 1 from mod m where m.repository_id = i.repository_id and m.module = i.base || '.' || i.imported)),
wlk as (with recursive w as (select repository_id, m0, n0, m0 as at, n0 as name, '' way, 0 hop, null::varchar dst from ask union all
  select w.repository_id, w.m0, w.n0, l.base, case when l.star then w.name else nullif(l.imported, '') end, w.way || case when l.star then '1' else '0' end, w.hop + 1,
    case when not l.star and l.imported = '' then l.base else coalesce(t.dst, case when not l.star then m.module end) end
  from w join lnk l on l.repository_id = w.repository_id and l.at = w.at and (l.star or l.name = w.name) left join tops t on t.repository_id = w.repository_id and t.module = l.base and t.name = case when l.star then w.name else l.imported end
    left join mod m on m.repository_id = w.repository_id and m.module = l.base || '.' || l.imported where w.hop < 5 and w.dst is null and w.name is not null and l.base is not null) select repository_id, m0, n0, arg_min(dst, way) dst from w where dst is not null group by all),
bnd as (select i.*, case when i.imported is null then i.base else coalesce(t.dst, m.module, k.dst) end dst, case when i.base is null then 'external' when i.imported is null then 'module' when t.dst is not null then 'symbol' when m.module is not null then 'submodule' when k.dst is not null then 'passed on' else 'unknown' end as rule
  from imp i left join tops t on t.repository_id = i.repository_id and t.module = i.base and t.name = i.imported left join mod m on m.repository_id = i.repository_id and m.module = i.base || '.' || i.imported left join wlk k on k.repository_id = i.repository_id and k.m0 = i.base and k.n0 = i.imported)"""


@query(f"with {IMPORTS} select repository_id, module, ordinal, local_name, dst_fqn, confidence, rule from (select *, dst dst_fqn, (case when rule = 'external' then 0.9 when rule = 'unknown' then 0.3 else 1.0 end)::double confidence from bnd)")
def resolve_imports(spark, d):
    """What every import binds: modules, symbols, submodules, names passed on by others, unknown and external ones."""
    m, s = modules(spark, d), cut(symbols(spark, d))
    return X.bindings(imports(m, s), m, s).select("repository_id", "module", "ordinal", "local_name", "dst_fqn", "confidence", "rule")


@query(f"with {IMPORTS} select a.repository_id, a.m0 as module, a.n0 as name, k.dst as dst_fqn from ask a join wlk k using (repository_id, m0, n0)")
def resolve_reexport(spark, d):
    """Names that a module does not define and passes on from others, over at most five imports."""
    m, s = modules(spark, d), cut(symbols(spark, d))
    targets = cut(X.import_targets(imports(m, s), m))
    tops = X.top_level(s)
    asked = targets.filter("imported_symbol is not null and is_known").select("repository_id", F.col("base").alias("module"), F.col("imported_symbol").alias("name")).distinct()
    asked = asked.join(tops, ["repository_id", "module", "name"], "left_anti").withColumn("sub", F.concat_ws(".", "module", "name")).join(m.select("repository_id", F.col("module").alias("sub")), ["repository_id", "sub"], "left_anti")
    return X.follow_names(asked, targets, m, tops)


def references(m, s):
    """Per symbol a reference in each way: see the rules of ``resolution.resolve_uses``."""
    w = Window.partitionBy("repository_id").orderBy("symbol_id")
    first = X.top_level(s).groupBy("repository_id", "module").agg(F.min("name").alias("n1")).withColumnRenamed("module", "m1")
    classes = s.filter("kind = 'class'").groupBy("repository_id", F.col("module").alias("m1")).agg(F.min(F.struct("name", "fqn")).alias("c"))
    method = s.filter("kind = 'method'").groupBy("repository_id", F.col("parent_fqn").alias("class_fqn")).agg(F.min("name").alias("member"))
    a = _after(m, 1).join(first, ["repository_id", "m1"], "left").join(classes, ["repository_id", "m1"], "left").withColumn("class_fqn", F.col("c.fqn")).join(method, ["repository_id", "class_fqn"], "left").select("repository_id", "module", "n1", F.col("c.name").alias("c1"), "member")
    later = F.coalesce(F.lead("name", 3).over(w), F.concat(F.lit("unknown_"), F.col("symbol_id").cast("string")))
    nearby = F.lead("name").over(w)
    x = s.withColumns({"later": later, "nearby": nearby}).join(a, ["repository_id", "module"], "left")
    none = F.lit(None).cast("string")
    calls, is_method, is_class = F.lit("calls"), F.col("kind") == "method", F.col("kind") == "class"
    row = lambda no, kind, target, receiver, made, when=F.lit(True): F.when(when, F.struct(F.lit(no).alias("no"), kind.alias("k"), target.alias("target_name"), receiver.alias("receiver"), made.alias("receiver_type")))
    rows = F.array(row(0, calls, F.col("later"), none, none), row(1, calls, F.col("nearby"), F.lit("self"), none, is_method), row(2, calls, F.col("later"), F.lit("self.store"), none, is_method), row(3, calls, F.coalesce("member", F.lit("run")), F.lit("obj"), F.col("c1"), F.col("c1").isNotNull()),
                   row(4, calls, F.col("n1"), F.lit("lib"), none), row(5, calls, F.lit(MISSING), F.lit("lib"), none), row(6, calls, F.col("later"), F.lit("ext.sub"), none), row(7, F.lit("tests"), F.col("n1"), none, none), row(8, F.lit("inherits"), F.col("nearby"), none, none, is_class), row(9, calls, F.col("n1"), none, none), row(10, calls, F.lit(MISSING), none, none))
    x = x.select("repository_id", "symbol_id", "module", F.col("fqn").alias("from_fqn"), F.explode(F.array_compact(rows)).alias("r")).filter("r.target_name is not null")
    return x.select("repository_id", (F.col("symbol_id") * 16 + F.col("r.no")).alias("ref_id"), "module", F.col("r.k").alias("kind"), "from_fqn", "r.target_name", "r.receiver", "r.receiver_type")


def labels(m, s):
    """What some of the references are known to mean: a member of the class an object was made from, a name of a module by
    alias and by import, names from outside and names that nobody has."""
    tops = X.top_level(s)
    first = tops.groupBy("repository_id", "module").agg(F.min_by("t_dst", "name").alias("n1")).withColumnRenamed("module", "m1")
    made = s.filter("kind = 'class'").groupBy("repository_id", F.col("module").alias("m1")).agg(F.min(F.struct("name", "fqn"))["fqn"].alias("owner"))
    member = s.filter("parent_fqn is not null").groupBy("repository_id", F.col("parent_fqn").alias("owner"), "name").agg(F.max_by("fqn", "symbol_id").alias("dst"), F.count_if(F.col("kind") == "method").alias("methods"))
    member = member.filter("methods > 0").groupBy("repository_id", "owner").agg(F.min_by("dst", "name").alias("member"))
    a = _after(m, 1).join(first, ["repository_id", "m1"], "left").join(made, ["repository_id", "m1"], "left").join(member, ["repository_id", "owner"], "left")
    x = s.select("repository_id", "symbol_id", "module").join(a, ["repository_id", "module"], "left")
    none = F.lit(None).cast("string")
    row = lambda no, kind, target, when=F.lit(True): F.when(when, F.struct(F.lit(no).alias("no"), kind.alias("label_kind"), target.alias("target")))
    symbol, gone, out = F.lit("symbol"), F.lit("unresolved"), F.lit("external")
    rows = F.array(row(3, F.when(F.col("member").isNull(), gone).otherwise(symbol), F.col("member"), F.col("owner").isNotNull()), *[row(n, symbol, F.col("n1"), F.col("n1").isNotNull()) for n in (4, 9)], row(5, gone, none), row(6, out, none), row(10, gone, none))
    return x.select("repository_id", "module", "symbol_id", F.explode(F.array_compact(rows)).alias("r")).select("repository_id", "module", (F.col("symbol_id") * 16 + F.col("r.no")).alias("ref_id"), "r.label_kind", "r.target")


_SHAPES = [(0, "calls", "later", "null", "null", "true"), (1, "calls", "nearby", "'self'", "null", "kind = 'method'"), (2, "calls", "later", "'self.store'", "null", "kind = 'method'"), (3, "calls", "coalesce(member, 'run')", "'obj'", "c1", "c1 is not null"), (4, "calls", "n1", "'lib'", "null", "true"), (5, "calls", f"'{MISSING}'", "'lib'", "null", "true"),
           (6, "calls", "later", "'ext.sub'", "null", "true"), (7, "tests", "n1", "null", "null", "true"), (8, "inherits", "nearby", "null", "null", "kind = 'class'"), (9, "calls", "n1", "null", "null", "true"), (10, "calls", f"'{MISSING}'", "null", "null", "true")]
_UNION = " union all ".join(f"select repository_id, symbol_id * 16 + {no} ref_id, module, '{k}' rkind, fqn from_fqn, {target} target, {receiver}::varchar receiver, {made}::varchar made from smx where {when}" for no, k, target, receiver, made, when in _SHAPES)
USES = IMPORTS + f""", cls as (select repository_id, module, min((name, fqn)) c from ysm where kind = 'class' group by all), mth as (select repository_id, parent_fqn, min(name) member from ysm where kind = 'method' group by all),
smx as (select y.*, coalesce(lead(y.name, 3) over w, 'unknown_' || y.symbol_id::varchar) later, lead(y.name) over w nearby, x.n1, struct_extract_at(c.c, 1) c1, h.member from ysm y left join nxt x on x.repository_id = y.repository_id and x.module = y.module
  left join cls c on c.repository_id = y.repository_id and c.module = x.m1 left join mth h on h.repository_id = y.repository_id and h.parent_fqn = struct_extract_at(c.c, 2) window w as (partition by y.repository_id order by y.symbol_id)),
rf0 as (select * from ({_UNION}) where target is not null),
arr as (select repository_id, fqn, case when arg_max(kind, symbol_id) = 'class' then fqn when arg_max(kind, symbol_id) = 'method' then arg_max(coalesce(parent_fqn, ''), symbol_id) end as owner from ysm group by repository_id, fqn),
nam as (select repository_id, module, local_name as name, arg_max((coalesce(dst, ''), rule, coalesce(base, ''), imported is null), ordinal) b from bnd where local_name <> '*' group by all),
rf1 as (select r.*, a.owner, rkind <> 'tests' and receiver in ('self', 'this', 'cls') mine, rkind = 'tests' or receiver is null bare from rf0 r left join arr a on a.repository_id = r.repository_id and a.fqn = r.from_fqn),
heu as (select r.*, coalesce(c.n, 0) n, c.dst hdst from rf1 r left join lateral (select case when not r.bare and count_if(y.kind = 'method') > 0 then count_if(y.kind = 'method') else count(*) end n, case when not r.bare and count_if(y.kind = 'method') > 0 then min(case when y.kind = 'method' then y.fqn end) else min(y.fqn) end dst
  from ysm y where y.repository_id = r.repository_id and y.name = r.target and (coalesce(r.receiver, '') not like 'self.%' or r.owner is null or y.parent_fqn is distinct from r.owner)) c on true),
lok as (select h.*, b.b, t.dst tdst, struct_extract_at(p.b, 3) amod, p.b is not null and struct_extract_at(p.b, 4) and struct_extract_at(p.b, 2) = 'module' is_alias, coalesce(struct_extract_at(o.b, 4) and struct_extract_at(o.b, 2) = 'external', false) is_out
  from heu h left join nam b on b.repository_id = h.repository_id and b.module = h.module and b.name = h.target left join tops t on t.repository_id = h.repository_id and t.module = h.module and t.name = h.target
  left join nam p on p.repository_id = h.repository_id and p.module = h.module and p.name = h.receiver and not h.bare left join nam o on o.repository_id = h.repository_id and o.module = h.module and o.name = split_part(h.receiver, '.', 1) and not h.bare),
bas as (select repository_id, from_fqn as owner, coalesce(case when b is not null then nullif(struct_extract_at(b, 1), '') else coalesce(tdst, hdst) end) base, min(ref_id) o from lok where rkind = 'inherits' group by all),
own as (select repository_id, parent_fqn as owner, name, arg_max(fqn, symbol_id) dst from ysm where parent_fqn is not null group by all),
up as (with recursive u as (select repository_id, owner, base as at, 1 as lv, lpad(o::varchar, 20, '0') way from bas where base is not null union all select u.repository_id, u.owner, b.base, u.lv + 1, u.way || lpad(b.o::varchar, 20, '0') from u join bas b on b.repository_id = u.repository_id and b.owner = u.at where u.lv < 5 and b.base is not null) select * from u),
mem as (select repository_id, owner, name, arg_min(dst, way) dst from (select repository_id, owner, name, dst, '' way from own union all select u.repository_id, u.owner, o.name, o.dst, u.way from up u join own o on o.repository_id = u.repository_id and o.owner = u.at) group by all),
typ as (select l.repository_id, l.module, l.made, case when any_value(n.b) is not null then nullif(struct_extract_at(any_value(n.b), 1), '') else coalesce(any_value(t.dst), min(y.fqn)) end fqn from (select distinct repository_id, module, made from lok where made is not null and not bare and not mine) l
  left join nam n on n.repository_id = l.repository_id and n.module = l.module and n.name = l.made left join tops t on t.repository_id = l.repository_id and t.module = l.module and t.name = l.made left join ysm y on y.repository_id = l.repository_id and y.name = l.made group by all),
tyc as (select t.* from typ t where exists (select 1 from arr a where a.repository_id = t.repository_id and a.fqn = t.fqn and a.owner = a.fqn)),
pck as (select l.*, m.dst mdst, a.dst adst, case when mine and m.dst is not null then 'self' when not mine and not bare and m.dst is not null then 'typed' when not mine and not bare and is_alias then 'alias' when not mine and not bare and is_out then 'external' when bare and b is not null then 'import' when bare and tdst is not null then 'module' else 'name' end as rule
  from lok l left join tyc t on t.repository_id = l.repository_id and t.module = l.module and t.made = l.made and not l.mine and not l.bare left join mem m on m.repository_id = l.repository_id and m.owner = case when l.mine then l.owner else t.fqn end and m.name = l.target and l.rkind <> 'inherits'
  left join tops a on l.is_alias and a.repository_id = l.repository_id and a.module = l.amod and a.name = l.target),
out as (select *, case rule when 'self' then mdst when 'typed' then mdst when 'alias' then adst when 'external' then null when 'import' then nullif(struct_extract_at(b, 1), '') when 'module' then tdst else hdst end dst_fqn from pck),
res as (select repository_id, ref_id, rkind, from_fqn, target, module, rule, dst_fqn, case when dst_fqn is not null then null when rkind = 'tests' then target when rule = 'alias' then amod || '.' || target when rule = 'external' then receiver || '.' || target else target end dst_unresolved_name,
  (case when rkind = 'tests' then case when dst_fqn is not null then 0.6 else 0.3 end when rule in ('self', 'module') then 1.0 when rule = 'typed' then 0.9 when rule = 'alias' then case when dst_fqn is not null then 1.0 else 0.3 end when rule = 'external' then 0.9
   when rule = 'import' then case struct_extract_at(b, 2) when 'external' then 0.9 when 'unknown' then 0.3 else 1.0 end when n = 0 then 0.3 when n = 1 then 0.8 else 0.5 end)::double confidence from out)"""


def _resolved(spark, d):
    m, s = cut(modules(spark, d)), cut(symbols(spark, d))
    return X.resolve(references(m, s), imports(m, s), m, s).join(m.select("repository_id", "module", "language"), ["repository_id", "module"])


@query(f"with {USES} select ref_id, rkind as kind, dst_fqn, case when rule = 'import' and dst_fqn is null and rkind <> 'tests' then (select any_value(base || '.' || imported) from bnd where bnd.repository_id = res.repository_id and bnd.module = res.module and bnd.local_name = res.target) else dst_unresolved_name end as dst_unresolved_name, confidence, rule from res")
def resolve_refs(spark, d):
    """Every reference with its edge, each rule among them; the name of an unknown import is compared without its spelling."""
    r = _resolved(spark, d)
    plain = F.regexp_replace("dst_unresolved_name", r"^(\.\./)+", "")
    return r.select("ref_id", "kind", "dst_fqn", plain.alias("dst_unresolved_name"), "confidence", "rule")


@query(f"""with {USES}, g as (select m.lang as language, count(*) edges, count_if(dst_fqn is not null) resolved, count_if(dst_fqn is null and confidence = 0.9) external, count_if(dst_fqn is null and confidence <> 0.9) unresolved from res join mod m using (repository_id, module) group by rollup (m.lang))
select language, edges, resolved, external, unresolved, case when resolved + unresolved = 0 then 1.0 else round(resolved / (resolved + unresolved), 6) end as rate from g""")
def resolution_stats(spark, d):
    return G.resolution_stats(_resolved(spark, d)).drop("is_total")


@query()
def resolve_parsed(spark, d):
    """References and imports as the parsers read them in the source files, resolved."""
    files = R.files(spark, d)
    parsed = cut(parsing.parse_files(files).join(files.select("file_id", "repository_id"), "file_id"))
    return X.resolve(*X.from_parsed(parsed)).select("repository_id", "ref_id", "kind", "from_fqn", "dst_fqn", "dst_unresolved_name", "confidence", "rule")
