"""Controllers: ``--flag value`` strings as maps, node tables and grammar checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLAG = r"--([A-Za-z]+[0-9]*)\s+(\S+)"


def argv(col: Column) -> Column:
    """All words of the controller, in order."""
    return F.filter(F.split(F.trim(col), r"\s+"), lambda w: w != "")


def pairs(col: Column) -> Column:
    """Array of (flag, value) in order of appearance; values that are no numbers become NULL."""
    names = F.regexp_extract_all(col, F.lit(FLAG), F.lit(1))
    values = F.regexp_extract_all(col, F.lit(FLAG), F.lit(2))
    return F.zip_with(
        names,
        values,
        lambda n, v: F.struct(n.alias("flag"), v.try_cast("double").alias("value")),
    )


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly over the tasks of a shuffle. Controllers are short and take long to
    take apart: a file of a few splits holds millions of them."""
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(tasks)


def tokens(df: DataFrame, controller: str) -> DataFrame:
    """One row per flag: its place ``pos`` (from 0), ``flag`` and ``value``."""
    return spread(df).select("*", F.posexplode(pairs(F.col(controller))).alias("pos", "_p")).select(
        *df.columns, "pos", "_p.flag", "_p.value"
    )


def _with_values(df: DataFrame, keep: list[str]) -> DataFrame:
    """Add ``_names`` (all flags in order) and ``_m`` (value of the first use of each flag) to ``_p``."""
    named = df.select(*keep, "_p", F.transform("_p", lambda p: p["flag"]).alias("_names"))
    first = F.filter("_p", lambda p, i: F.array_position(F.col("_names"), p["flag"]) == i + 1)
    unique = F.size(F.array_distinct("_names")) == F.size("_names")
    found = F.when(unique, F.map_from_entries("_p")).otherwise(F.map_from_entries(first))
    return named.select(*keep, "_p", "_names", found.alias("_m"))


def nodes(df: DataFrame, key: str, controller: str) -> DataFrame:
    """One row per condition or action node, with its code and parameters.

    Nodes are the flags n<branch><slot> that the controller has, however many branches there
    are; the last digit is the slot (0: condition, others: action). A flag of that form with
    the branch code as its value is a branch of its own and no node.
    """
    mapped = _with_values(spread(df.select(key, controller)).select(key, pairs(F.col(controller)).alias("_p")), [key])

    def value(name: Column) -> Column:
        return F.try_element_at(F.col("_m"), name)

    def node(place: Column) -> Column:
        branch, slot = F.substring(place, F.lit(1), F.length(place) - 1), F.right(place, F.lit(1))
        condition = slot == "0"

        def parameter(flag: str, of: Column) -> Column:
            return F.when(of, value(F.concat(F.lit(flag), place))).alias(flag)

        code = F.when(condition, value(F.concat(F.lit("c"), place))).otherwise(value(F.concat(F.lit("a"), place)))
        return F.struct(
            branch.cast("int").alias("branch"),
            F.when(condition, "condition").otherwise("action").alias("role"),
            code.cast("int").alias("code"),
            parameter("p", F.lit(True)), parameter("w", condition),
            *(parameter(flag, ~condition) for flag in ("rwm", "att", "rep")),
        )

    places = F.transform(
        F.filter(F.array_distinct("_names"), lambda n: F.regexp_like(n, F.lit("^n[0-9]{2,}$"))), lambda n: F.substring(n, F.lit(2), F.length(n))
    )
    known = F.filter(places, lambda x: F.coalesce(value(F.concat(F.lit("n"), x)) != BRANCH_CODE, F.lit(False)))
    return mapped.select(key, F.explode(F.transform(known, node)).alias("_n")).select(key, "_n.*")


# Node codes and parameter ranges of the controller grammar.
ROOT_CODE, BRANCH_CODE, CONDITION_CODE, ACTION_CODE = 3, 0, 6, 5
CHILDREN_PER_BRANCH, MAX_BRANCHES = 2, 4
CODES = (0, 1, 2, 3, 4, 5)
PROBABILITY_CONDITIONS, NEIGHBOUR_CONDITIONS = (0, 1, 2, 5), (3, 4)
NEIGHBOUR_RANGE, WEIGHT_RANGE = (1, 10), (0, 20)
ACTION_PARAMETERS = {0: ("rwm", "i", 1, 100), 4: ("att", "r", 1, 5), 5: ("rep", "r", 1, 5)}

@dataclass(frozen=True)
class Rule:
    """One flag: its kind (c: one of ``domain``, i: whole number, r: number in the range
    ``domain``) and the flag and values on which it applies (``op``: in, or > for the first)."""

    flag: str
    kind: str
    domain: tuple[float, ...]
    parent: str | None = None
    op: str = "in"
    values: tuple[float, ...] = ()


def default_grammar(branches: int = MAX_BRANCHES) -> list[Rule]:
    """The grammar: which flags exist, their domain, and when they apply."""
    rules = [Rule("nroot", "c", (ROOT_CODE,)), Rule("nchildroot", "i", (1, branches))]
    for i in range(branches):
        here = (f"n{i}", "in", (BRANCH_CODE,))
        rules += [
            Rule(f"n{i}", "c", (BRANCH_CODE,), "nchildroot", ">", (i,)),
            Rule(f"nchild{i}", "c", (CHILDREN_PER_BRANCH,), *here),
            Rule(f"n{i}0", "c", (CONDITION_CODE,), *here),
            Rule(f"c{i}0", "c", CODES, *here),
            Rule(f"p{i}0", "r", (0, 1), f"c{i}0", "in", PROBABILITY_CONDITIONS),
            Rule(f"p{i}0", "i", NEIGHBOUR_RANGE, f"c{i}0", "in", NEIGHBOUR_CONDITIONS),
            Rule(f"w{i}0", "r", WEIGHT_RANGE, f"c{i}0", "in", NEIGHBOUR_CONDITIONS),
            Rule(f"n{i}1", "c", (ACTION_CODE,), *here),
            Rule(f"a{i}1", "c", CODES, *here),
            Rule(f"p{i}1", "c", (0,), *here),
        ]
        for code, (flag, kind, low, high) in ACTION_PARAMETERS.items():
            rules.append(Rule(f"{flag}{i}1", kind, (low, high), f"a{i}1", "in", (code,)))
    return rules


# Codes and ranges of the tree grammar.
TREE_ROOTS, TREE_NODES, TREE_LEAVES, TREE_ACTIONS = (0, 1, 2, 3), (0, 3, 5, 6), (5, 6), (1, 2, 3, 4, 5, 6, 7)
TREE_PROBABILITY_CONDITIONS, TREE_NEIGHBOURS = (0, 1, 2, 5, 6, 7), {3: (1, 20), 4: (1, 10)}


def tree_grammar(branches: int = 3, children: int = 3) -> list[Rule]:
    """The grammar of general two-level trees: below the root nodes that branch, act or test,
    below a branching one up to ``children`` that act or test."""

    def node(path: str, codes: tuple[int, ...], parent: str, more_than: int) -> list[Rule]:
        acts, tests = (f"n{path}", "in", (ACTION_CODE,)), (f"n{path}", "in", (CONDITION_CODE,))
        found = [
            Rule(f"n{path}", "c", codes, parent, ">", (more_than,)),
            Rule(f"a{path}", "c", TREE_ACTIONS, *acts),
            Rule(f"p{path}", "r", (0, 1), *acts),
            Rule(f"att{path}", "r", (1, 5), f"a{path}", "in", (4,)),
            Rule(f"rep{path}", "r", (1, 5), f"a{path}", "in", (5,)),
            Rule(f"c{path}", "c", CODES, *tests),
            Rule(f"p{path}", "r", (0, 1), f"c{path}", "in", TREE_PROBABILITY_CONDITIONS),
        ]
        for code, span in TREE_NEIGHBOURS.items():
            found.append(Rule(f"p{path}", "i", span, f"c{path}", "in", (code,)))
            found.append(Rule(f"w{path}", "r", WEIGHT_RANGE, f"c{path}", "in", (code,)))
        return found

    rules = [Rule("nroot", "c", TREE_ROOTS), Rule("nchildroot", "i", (1, branches))]
    for i in range(branches):
        rules += node(f"{i}", TREE_NODES, "nchildroot", i)
        rules.append(Rule(f"nchild{i}", "i", (1, children), f"n{i}", "in", TREE_ROOTS))
        for k in range(children):
            rules += node(f"{i}{k}", TREE_LEAVES, f"nchild{i}", k)
    return rules


def grammar_problems(df: DataFrame, controller: str, grammar: list[Rule]) -> DataFrame:
    """Add ``problems``, an array of (flag, problem) with every rule a controller breaks.

    The rules become plain column expressions over one array with the values of all flags
    that the grammar names; every controller is checked in place.
    """
    flags = list(dict.fromkeys(r.flag for r in grammar))
    place = {f: i + 1 for i, f in enumerate(flags)}
    text = F.coalesce(F.col(controller), F.lit(""))
    listed = F.array(*map(F.lit, flags))
    rows = spread(df).select("*", pairs(text).alias("_p"), F.size(argv(text)).alias("_words"))
    rows = rows.withColumn("_names", F.transform("_p", lambda p: p["flag"]))
    # where each flag is used first, 0 if nowhere, and its value there
    rows = rows.withColumn("_where", F.transform(listed, lambda f: F.array_position("_names", f).cast("int")))
    rows = rows.withColumn("_values", F.transform("_where", lambda i: F.when(i > 0, F.get("_p", i - 1)["value"])))

    def at(column: str, flag: str) -> Column:
        return F.get(column, F.lit(place[flag] - 1))

    def applies(rule: Rule) -> Column:
        if rule.parent is None:
            return F.lit(True)
        parent = at("_values", rule.parent)
        return parent > rule.values[0] if rule.op == ">" else parent.isin(*rule.values)

    def fits(rule: Rule) -> Column:
        v = at("_values", rule.flag)
        if rule.kind == "c":
            return v.isin(*rule.domain)
        span = v.between(rule.domain[0], rule.domain[1])
        return span & (v == F.floor(v)) if rule.kind == "i" else span

    def problem(rule: Rule) -> Column:
        found = F.when(at("_where", rule.flag) == 0, "missing").when(~F.coalesce(fits(rule), F.lit(False)), "out of range")
        return F.when(F.coalesce(applies(rule), F.lit(False)) & found.isNotNull(), F.struct(F.lit(rule.flag).alias("flag"), found.alias("problem")))

    allowed = [F.when(F.coalesce(applies(r), F.lit(False)), F.lit(r.flag)) for r in grammar]
    rows = rows.withColumns({"_allowed": F.array_compact(F.array(*allowed)), "_distinct": F.array_distinct("_names")})
    stray = F.transform(
        F.array_except("_distinct", "_allowed"),
        lambda f: F.struct(f.alias("flag"), F.when(F.array_contains(listed, f), "not applicable").otherwise("unknown").alias("problem")),
    )
    several = F.filter("_distinct", lambda f: F.size(F.filter("_names", lambda n: n == f)) > 1)
    repeated = F.when(F.size("_distinct") < F.size("_names"), F.transform(several, lambda f: F.struct(f.alias("flag"), F.lit("repeated").alias("problem"))))
    # words that are no flag/value pair leave the string malformed
    malformed = F.when(
        F.col("_words") != 2 * F.size("_p"),
        F.array(F.struct(F.lit(None).cast("string").alias("flag"), F.lit("malformed").alias("problem"))),
    )
    none = F.array().cast("array<struct<flag:string,problem:string>>")
    problems = F.concat(
        F.array_compact(F.array(*map(problem, grammar))), stray, F.coalesce(repeated, none), F.coalesce(malformed, none)
    )
    # no controller at all has every mandatory flag missing
    return rows.select(*df.columns, problems.alias("problems"))


def grammar_violations(df: DataFrame, key: str, controller: str, grammar: list[Rule]) -> DataFrame:
    """The problems of all controllers as rows (key, flag, problem)."""
    found = grammar_problems(df, controller, grammar).select(key, F.explode("problems").alias("_v"))
    return found.select(key, "_v.flag", "_v.problem")
