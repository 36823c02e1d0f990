"""Registered queries of the plans that work in rounds over facts: scripts made of orders, lines and customers, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptmill.functions import js, values
from scriptmill.kernel import patterns as p
from scriptmill.plans import edits, folding, liveness, machines, proxies, rotation, sequences, twigs
from scriptmill.plans.catalogue import _t, query
from scriptmill.session import written
from scriptmill.sources import bundles, facts, scripts, spans


def _tasks(spark: SparkSession) -> int:
    """Tasks that rows are dealt out to. Named, so that Spark doesn't join them by their bytes: a small row may be much work."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _dealt(rows: DataFrame) -> DataFrame:
    """The rows by script, in as many tasks as the session shuffles to: parsing takes far longer than reading."""
    return rows.repartition(_tasks(rows.sparkSession), "script_id")


# -- expressions ------------------------------------------------------------------------------------------------------


@query("""select l_orderkey as script_id, (sum(l_quantity::bigint * l_linenumber) - 1)::varchar as total, (sum(l_quantity::bigint) % 7 > 3)::varchar as many, (-count(*) - 1)::varchar as flipped,
string_agg(l_returnflag, '' order by l_linenumber, l_quantity, l_returnflag) as flags from lineitem group by 1""")
def folded_sums(spark: SparkSession, sf: str) -> DataFrame:
    """Each order's lines as a script: sums of products, comparisons, bits and texts that are known without running it."""
    own = _dealt(_t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("script_id"), "l_linenumber", "l_quantity", "l_returnflag")).groupBy("script_id").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("long").alias("q"), "l_returnflag"))).alias("own"))
    part = lambda f, sep: F.array_join(F.transform("own", f), sep)
    text = lambda c: c.cast("string")
    sums = part(lambda x: F.concat(text(x["q"]), F.lit(" * "), text(x["l_linenumber"])), " + ")
    source = F.concat(
        F.lit("show("), sums, F.lit(" - 1, ("), part(lambda x: text(x["q"]), " + "), F.lit(") % 7 > 3, ~"), text(F.size("own")), F.lit(", "),
        part(lambda x: F.concat(F.lit('"'), x["l_returnflag"], F.lit('"')), " + "), F.lit(", order);"),
    )
    nodes = written(facts.nodes(own.select("script_id", source.alias("source"))))
    arguments = nodes.where("slot = 'arguments'").select("script_id", "node_id", "ordinal", F.col("str_value").alias("literal"))
    found = folding.fold(nodes).values.select("script_id", "node_id", values.text(F.col("value")).alias("text"))
    at = lambda i: F.max(F.when(F.col("ordinal") == i, F.coalesce("text", "literal")))
    return arguments.join(found, ["script_id", "node_id"], "left").groupBy("script_id").agg(at(0).alias("total"), at(1).alias("many"), at(2).alias("flipped"), at(3).alias("flags"))


# -- what is used -----------------------------------------------------------------------------------------------------


@query("""with o as (select o_custkey * 10 + o_orderpriority[1]::bigint as script_id, o_orderkey from orders),
p as (select script_id, o_orderkey, row_number() over (partition by script_id order by o_orderkey) as place, count(*) over (partition by script_id) as n from o),
r as (select script_id, 'f' || o_orderkey as name, (n - place)::int as round from p where place > script_id % (n + 1))
select script_id, name, round from r union all select script_id, 'kept', 0 from p where place = 1 and script_id % 3 = 0""")
def dead_chains(spark: SparkSession, sf: str) -> DataFrame:
    """A customer's orders of one priority as functions, each using the one before; what nothing uses dies from the last one back to one that is used."""
    own = _dealt(_t(spark, sf, "orders").select((F.col("o_custkey") * 10 + F.substring("o_orderpriority", 1, 1).cast("long")).alias("script_id"), "o_orderkey")).groupBy("script_id").agg(F.sort_array(F.collect_list("o_orderkey")).alias("own"))
    name = lambda k: F.concat(F.lit("f"), k.cast("string"))
    functions = F.array_join(F.transform("own", lambda k, i: F.concat(F.lit("function "), name(k), F.lit("() { return "), F.when(i > 0, F.concat(name(F.get("own", i - 1)), F.lit("() + 1"))).otherwise("1"), F.lit("; }"))), " ")
    used = F.col("script_id") % (F.size("own") + 1)
    call = F.when(used > 0, F.concat(F.lit(" use("), name(F.get("own", (used - 1).cast("int"))), F.lit(");"))).otherwise("")
    extra = F.when(F.col("script_id") % 3 == 0, " var kept = [1, -2], busy = g();").otherwise("")
    made = own.select("script_id", F.concat(F.lit("(function () { "), functions, call, extra, F.lit(" })();")).alias("source"))
    known = facts.every(made)
    gone = liveness.dead(known.nodes, known.symbols, known.references).units
    return gone.join(known.symbols.select("script_id", "symbol_id", "name"), ["script_id", "symbol_id"]).select("script_id", "name", "round")


# -- proxies ----------------------------------------------------------------------------------------------------------


@query("""with c as (select c_custkey // 10 as script_id, 'f' || c_custkey as name, c_custkey % 10 as place, c_custkey // 10 * 10 % 3 as first from customer)
select script_id, name, case when place = 9 then 'cycle' else 'binary' end as shape, case when place < 9 then case first when 0 then '+' when 1 then '-' else '*' end end as op,
case when place < 9 then case when place % 2 = 0 then '0,1' else '1,0' end end as places, place < 9 as inlinable from c""")
def proxy_chains(spark: SparkSession, sf: str) -> DataFrame:
    """Ten customers as functions: one adds, subtracts or multiplies, each next one hands its parameters on the other way round, and the
    last one calls itself."""
    own = _dealt(_t(spark, sf, "customer").select((F.col("c_custkey") / 10).cast("bigint").alias("script_id"), "c_custkey")).groupBy("script_id").agg(F.sort_array(F.collect_list("c_custkey")).alias("own"))
    name = lambda k: F.concat(F.lit("f"), k.cast("string"))
    first = lambda k: F.concat(F.lit("a "), F.when(k % 3 == 0, "+").when(k % 3 == 1, "-").otherwise("*"), F.lit(" b"))
    body = lambda k, i: F.when(k % 10 == 0, first(k)).when(k % 10 == 9, F.concat(name(k), F.lit("(a, b)"))).otherwise(F.concat(F.lit("("), name(F.get("own", i - 1)), F.lit("(b, a))")))
    text = F.array_join(F.transform("own", lambda k, i: F.concat(F.lit("function "), name(k), F.lit("(a, b) { return "), body(k, i), F.lit("; }"))), " ")
    made = own.select("script_id", text.alias("source"))
    all_of = facts.every(made)
    found, _ = proxies.resolve(all_of.nodes, all_of.symbols)
    known = F.col("shape") != "cycle"
    return found.select("script_id", "name", "shape", F.when(known, F.col("op")).alias("op"), F.when(known, F.array_join("places", ",")).alias("places"), "inlinable")


# -- machines ---------------------------------------------------------------------------------------------------------


@query("""select o_orderpriority as machine, (row_number() over (partition by o_orderpriority order by o_totalprice, o_orderkey) - 1)::int as depth, o_orderkey as state from orders""")
def long_state_trace(spark: SparkSession, sf: str) -> DataFrame:
    """A machine for each priority, whose states are all of its orders by price: as long as the table has orders."""
    w = Window.partitionBy("o_orderpriority").orderBy("o_totalprice", "o_orderkey")
    t = _t(spark, sf, "orders").select(F.col("o_orderpriority").alias("machine"), F.col("o_orderkey").alias("state"), F.lead("o_orderkey").over(w).alias("next"), (F.row_number().over(w) == 1).alias("first"))
    return machines.trace(t.drop("first"), t.where("first").select("machine", "state"))


@query("""with t as (select o_custkey as machine, o_orderkey as state, row_number() over (partition by o_custkey order by o_orderkey) as pos, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank, o_orderkey % 3 = 0 as entry from orders),
b as (select machine, state, pos, min(case when entry then {'rank': rank, 'pos': pos} end) over (partition by machine order by pos rows unbounded preceding) as best from t)
select machine, best.rank::int as rank, (pos - best.pos)::int as depth, state from b where best is not null""")
def dispatch_cases(spark: SparkSession, sf: str) -> DataFrame:
    """A customer's orders as the cases of a switch, some of them entries: cases that entries share go to the first of them."""
    o = _t(spark, sf, "orders")
    by_key, by_price = Window.partitionBy("o_custkey").orderBy("o_orderkey"), Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    t = o.select(F.col("o_custkey").alias("machine"), F.col("o_orderkey").alias("state"), F.lead("o_orderkey").over(by_key).alias("next"), F.row_number().over(by_price).alias("rank"))
    return machines.owners(t.drop("rank"), t.where("state % 3 = 0").select("machine", "state", "rank"))


# -- rotations --------------------------------------------------------------------------------------------------------


@query("""select l_linenumber as array_id, 17 as rotation from lineitem group by 1 having count(*) > 17""")
def long_rotations(spark: SparkSession, sf: str) -> DataFrame:
    """The parts of all lines of one number as an array, with the checksum that it has when turned by 17: seven arrays of any length."""
    order = ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity"]
    lines = _t(spark, sf, "lineitem").select(F.col("l_linenumber").alias("array_id"), F.col("l_partkey").alias("x"), *order)
    own = written(rotation.placed(lines, order, _tasks(spark)))
    n = own.groupBy("array_id").agg(F.count("*").alias("n")).where("n > 17")
    weight = F.pmod(F.col("place") - 17, F.col("n")) + 1
    target = F.sum(F.col("x").cast("decimal(19,0)") * weight.cast("decimal(18,0)")).cast("decimal(38,0)")
    targets = own.join(F.broadcast(n), "array_id").groupBy("array_id").agg(target.alias("target"))
    return rotation.solve_placed(own, targets).select("array_id", "rotation")


@query("""select c_custkey // 10 as array_id, 3 as rotation from customer group by 1 having count(*) = 10""")
def checksum_rotations(spark: SparkSession, sf: str) -> DataFrame:
    """Ten customers as texts that begin with a number, and a checksum of three terms, as decoders have it, of the turn by three."""
    c = _t(spark, sf, "customer").select((F.col("c_custkey") / 10).cast("long").alias("array_id"), (F.col("c_custkey") % 10).cast("int").alias("place"), F.concat((F.col("c_custkey") * 7 + F.col("c_nationkey")).cast("string"), "c_name").alias("text"), (F.col("c_custkey") * 7 + F.col("c_nationkey")).cast("double").alias("x"))
    whole = c.groupBy("array_id").agg(F.count("*").alias("n"), F.map_from_entries(F.collect_list(F.struct("place", "x"))).alias("x")).where("n = 10")
    x = lambda place: F.element_at("x", F.lit((place + 3) % 10))
    target = -x(0) / 1 * (x(4) / 2) + x(7) / 3 + -x(1) / 4 * (-x(8) / 5) * (x(2) / 6)
    factors = [(0, 0, 0, 1.0, -1.0), (0, 1, 4, 2.0, 1.0), (1, 0, 7, 3.0, 1.0), (2, 0, 1, 4.0, -1.0), (2, 1, 8, 5.0, -1.0), (2, 2, 2, 6.0, 1.0)]
    names = ("term", "factor", "place", "divisor", "sign")
    terms = whole.select("array_id", F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, f)]) for f in factors])).alias("f")).select("array_id", "f.*")
    return rotation.solve_checksum(c.join(whole, "array_id", "left_semi").select("array_id", "place", "text"), terms, whole.select("array_id", target.alias("target")))


@query("""select c_custkey // 10 as script_id, 'd' || c_custkey as name, c_custkey % 10 + 1 as hops from customer""")
def alias_roots(spark: SparkSession, sf: str) -> DataFrame:
    """Ten customers as names, each declared as the one before and the first as a decoder: what each stands for, through how many."""
    own = _dealt(_t(spark, sf, "customer").select((F.col("c_custkey") / 10).cast("long").alias("script_id"), "c_custkey")).groupBy("script_id").agg(F.sort_array(F.collect_list("c_custkey")).alias("own"))
    before = lambda i: F.when(i == 0, "decode").otherwise(F.concat(F.lit("d"), F.get("own", i - 1).cast("string")))
    text = F.array_join(F.transform("own", lambda k, i: F.concat(F.lit("var d"), k.cast("string"), F.lit(" = "), before(i), F.lit(";"))), " ")
    made = own.select("script_id", F.concat(F.lit("function decode(i) { return i; } "), text).alias("source"))
    known = facts.every(made)
    found, _ = rotation.aliases(known.nodes, known.symbols)
    names = known.symbols.select("script_id", "symbol_id", "name")
    root = names.withColumnsRenamed({"symbol_id": "root", "name": "root_name"})
    return found.join(names, ["script_id", "symbol_id"]).join(root, ["script_id", "root"]).where("root_name = 'decode'").select("script_id", "name", "hops")


# -- scripts of one page ----------------------------------------------------------------------------------------------


@query("""with s as (select page_id, regexp_extract(html, 'track\\(([0-9]+)\\)', 1) as n from pages)
select page_id, ordinal, name, declared_in, uses from s, (values (0, 'track', 1, 1::bigint), (1, 'total', 2, 1), (2, 'track', 1, 2), (2, 'missing', null, 1)) v(ordinal, name, declared_in, uses)""")
def bundled_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Each page's own script with two more: what one declares and another uses, over all scripts of the page."""
    pages = _t(spark, sf, "pages")
    own = scripts.from_pages(pages.select("page_id", "html"))
    last = own.groupBy("page_id").agg((F.max("ordinal") + 1).alias("next"))
    more = F.array(F.lit("function track(n) { total += n; }"), F.concat(F.lit("var total = "), F.col("page_id").cast("string"), F.lit("; track(total); missing(track);")))
    added = last.select("page_id", F.posexplode(more).alias("at", "source"), "next").select("page_id", (F.col("next") + F.col("at")).alias("ordinal"), "source")
    return bundles.bundled(own.unionByName(added))


# -- edits ------------------------------------------------------------------------------------------------------------


@query("""select o_custkey as script_id, string_agg('var b' || o_orderkey || ' = ' || o_orderkey || '; log(' || o_orderkey || E');\\nuse(b' || o_orderkey || '); ; one(' || o_orderkey || E');\\none(' || o_orderkey || ');', ' ' order by o_orderkey) as source from orders group by 1""")
def edited_scripts(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' scripts with four statements an order: a name renamed, a statement inserted, one removed, and one replaced by two."""
    k = lambda x: x.cast("string")
    part = lambda x: F.concat(F.lit("var a"), k(x), F.lit(" = "), k(x), F.lit("; use(a"), k(x), F.lit("); drop(a"), k(x), F.lit("); two("), k(x), F.lit(");"))
    own = _dealt(_t(spark, sf, "orders").select(F.col("o_custkey").alias("script_id"), "o_orderkey")).groupBy("script_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("o_orderkey")), part), " ").alias("source"))
    known, at = facts.every(own), written(spans.spans(own))
    nodes = known.nodes
    names = known.symbols.select("script_id", "symbol_id", F.concat(F.lit("b"), F.substring("name", 2, 20)).alias("name"))
    called = twigs.find(nodes, p.expression_statement(p.call(p.capture("f"), p.capture("x")))).select("script_id", "node_id", F.col("f.str").alias("f"), F.coalesce(F.substring("x.str", 2, 20), F.col("x.num").cast("long").cast("string")).alias("x"))
    texts = lambda name, n: F.array_repeat(F.concat(F.lit(f"{name}("), F.col("x"), F.lit(");")), n)
    action = F.when(F.col("f") == "use", "before").when(F.col("f") == "drop", "remove").otherwise("replace")
    more = called.select("script_id", "node_id", F.lit(1).cast("long").alias("number"), action.alias("action"), F.when(F.col("f") == "use", texts("log", 1)).otherwise(texts("one", 2)).alias("texts"))
    return edits.apply(own, edits.renames(nodes, at, names).unionByName(more), nodes, at)


# -- patterns ---------------------------------------------------------------------------------------------------------


@query("""select c_custkey as script_id, c_name as key, abs(c_acctbal) as amount, case when c_acctbal < 0 then '-' else '' end as sign, c_mktsegment as segment, c_nationkey % 2 = 0 as logged from customer""")
def pattern_matches(spark: SparkSession, sf: str) -> DataFrame:
    """What patterns capture in customers' scripts: a call's name and amount, the text that a condition compares to, and whether the
    branch's block is one log after any number of counters."""
    step = F.when(F.col("c_nationkey") % 2 == 0, "log(seen);").otherwise("log(seen); stop();")
    text = F.concat(F.lit('store.put("'), F.col("c_name"), F.lit('", '), F.col("c_acctbal").cast("string"), F.lit('); if (segment === "'), F.col("c_mktsegment"), F.lit('") { '), F.repeat(F.lit("seen++; "), F.col("c_nationkey").cast("int") % 3), step, F.lit(" }"))
    nodes = written(facts.nodes(_dealt(_t(spark, sf, "customer").select(F.col("c_custkey").alias("script_id"), text.alias("source")))))
    amount = p.or_(p.capture("amount", p.any_number), p.unary("-", p.capture("owed", p.any_number)))
    put = twigs.find(nodes, p.call(p.member(p.identifier("store"), p.identifier("put")), p.capture("key", p.any_string), amount)).select("script_id", F.col("key.str").alias("key"), F.coalesce("amount.num", "owed.num").alias("amount"), F.when(F.col("owed").isNotNull(), "-").otherwise("").alias("sign"))
    test = p.binary("===", p.identifier("segment"), p.capture("segment"))
    asked = twigs.find(nodes, p.if_(test, p.any_)).select("script_id", F.col("segment.str").alias("segment"))
    log = p.expression_statement(p.call(p.identifier("log"), p.any_identifier))
    whole = p.if_(test, p.block(p.repeat(p.and_(p.not_(log), twigs.has(p.identifier("seen")))), log))
    logged = twigs.find(nodes, whole).select("script_id", F.lit(True).alias("logged"))
    return put.join(asked, "script_id").join(logged, "script_id", "left").withColumn("logged", F.coalesce("logged", F.lit(False)))


@query("""with k as (select event_id // 4 as list_id, string_agg(event_type[1], '' order by event_id) as kinds from events group by 1)
select list_id, regexp_full_match(kinds, 'v*[cs]*[^e]p*') as fits, regexp_full_match(kinds, 'v*([cs]+[vp]|p)p*') as greedy from k""")
def statement_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Events four at a time as lists of statements: views, then clicks or signups, then one that is no error, then purchases. As a
    regular expression, and without giving back, where the one before the purchases can't be what the repeats have taken."""
    kind = F.col("event_type")
    items = [kind == "view", kind.isin("click", "signup"), kind != "error", kind == "purchase"]
    mask = F.lit(0)
    for i, fits in enumerate(items):
        mask = mask.bitwiseOR(F.when(fits, 1 << i).otherwise(0))
    own = sequences.lists(_t(spark, sf, "events").select((F.col("event_id") / 4).cast("long").alias("list_id"), F.col("event_id").alias("ordinal"), mask.alias("mask")), ["list_id"])
    repeats = [True, True, False, True]
    return own.select("list_id", sequences.accepts(F.col("masks"), repeats).alias("fits"), sequences.counts(F.col("masks"), repeats).isNotNull().alias("greedy"))


# -- scalar functions at the ends of doubles --------------------------------------------------------------------------

_ENDS = "case p_partkey % 7 when 0 then 'nan'::double when 1 then 'inf'::double when 2 then '-inf'::double when 3 then 1e20 when 4 then -1e20 when 5 then p_retailprice else -p_retailprice / 1000 end"


def _ends() -> Column:
    k = F.col("p_partkey") % 7
    return F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 2, float("-inf")).when(k == 3, 1e20).when(k == 4, -1e20).when(k == 5, F.col("p_retailprice")).otherwise(-F.col("p_retailprice") / 1000)


@query(f"""with v as (select p_partkey, {_ENDS} as x from part), r as (
select p_partkey, x, case when abs(x) >= 9007199254740992 or isnan(x) then x else ceil(x) end as up, case when abs(x) >= 9007199254740992 or isnan(x) then x else floor(x) end as down, case when abs(x) >= 9007199254740992 or isnan(x) then x else trunc(x) end as whole,
case when abs(x) >= 9007199254740992 or isnan(x) then x else sign(x) * floor(abs(x) + 0.5) end as near, case when isfinite(x * x) then x * x end as squared from v)
select p_partkey, case when isnan(up) then 0.25 else up end as up, case when isnan(down) then 0.25 else down end as down, case when isnan(whole) then 0.25 else whole end as whole, case when isnan(near) then 0.25 else near end as near, squared from r""")
def js_math_ends(spark: SparkSession, sf: str) -> DataFrame:
    """Rounding of NaN, infinities and numbers beyond 64-bit integers; what stays NaN, which equals nothing, is shown as a quarter."""
    d = _t(spark, sf, "part").select("p_partkey", _ends().alias("x"))
    shown = lambda c: F.when(F.isnan(c), 0.25).otherwise(c)
    return d.select("p_partkey", shown(js.ceil("x")).alias("up"), shown(js.floor("x")).alias("down"), shown(js.trunc("x")).alias("whole"), shown(js.round_("x")).alias("near"), js.math_pow("x", 2.0).alias("squared"))


@query(f"""with v as (select p_partkey, {_ENDS} as x, case when p_partkey % 2 = 0 then 'nan'::double else 1e20 end as y from part), n as (select *, not isnan(x) and not isnan(y) as fine from v)
select p_partkey, fine and x < y as less, fine and x <= y as at_most, fine and x > y as more, fine and x >= y as at_least, fine and x = y as loose, not (fine and x = y) as loosely_not, fine and x = y as strict, not (fine and x = y) as strictly_not from n""")
def js_comparisons_ends(spark: SparkSession, sf: str) -> DataFrame:
    """All eight comparisons where NaN, infinities and large numbers meet: nothing compares to NaN."""
    y = F.when(F.col("p_partkey") % 2 == 0, float("nan")).otherwise(1e20)
    d = _t(spark, sf, "part").select("p_partkey", _ends().alias("x"), y.alias("y"))
    each = {"less": js.less, "at_most": js.less_equal, "more": js.greater, "at_least": js.greater_equal, "loose": js.equal, "loosely_not": js.not_equal, "strict": js.strict_equal, "strictly_not": js.strict_not_equal}
    return d.select("p_partkey", *[f("x", "y").alias(n) for n, f in each.items()])
