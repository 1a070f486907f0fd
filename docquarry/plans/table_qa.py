"""Questions about a table: a small plan of tasks, each run as one DataFrame query."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from docquarry.functions import text as T
from docquarry.shared_files import fresh_name

from .profile import ColumnProfile, compact, normalize, profile_table, unpivoted
from .vocabulary import (
    ABOUT, AGE_WORDS, ALIASES, BETWEEN_COMPARED, BETWEEN_PARTS, COMPARED, FILTER_WORDS, GOES_ON, GROUP, HOW_MANY, INTENTS, KEYWORD, MEN,
    PART_RULES, STOPWORDS, TITLE, TITLES, WOMEN,
)

LIMIT, MAX_TASKS, MAX_FILTERS, MAX_ENTITIES, FUZZY_ROWS, FUZZY = 200, 5, 6, 4, 200, 0.82
MAX_COLUMNS, MAX_SAMPLES, ATTEMPTS = 60, 8, 2
OPS = ("contains", "equals", "gt", "lt", "gte", "lte", "between")
Planner = Callable[[str, list[ColumnProfile]], "str | dict | None"]
#: A language model: a prompt gives a text.
Model = Callable[[str], str]


@dataclass(frozen=True)
class Task:
    kind: str
    text: str = ""
    entity: str | None = None
    entities: tuple[str, ...] = ()
    target: str | None = None
    group_by: str | None = None
    op: str | None = None
    direction: str | None = None
    filters: tuple[dict, ...] = field(default=())


# ── understanding the question ──────────────────────────────────────────────


def keywords(question: str, more_stopwords: frozenset[str] = frozenset()) -> list[str]:
    words = re.findall(KEYWORD, question.lower())
    return [w for w in words if w not in STOPWORDS and w not in more_stopwords and not re.fullmatch(r"\d{1,2}", w)]


def is_code(word: str) -> bool:
    return any(c.isdigit() for c in word) and any(c.isascii() and c.isalpha() for c in word)


def search_keywords(words: list[str]) -> list[str]:
    """Codes, which mix letters and digits, say more than words: where there are any, only they count."""
    return list(filter(is_code, words)) or words


def intent(question: str) -> str:
    return next((name for name, pattern in INTENTS if re.search(pattern, question, re.I)), "LOOKUP" if keywords(question) else "NONE")


def before(text: str, stop: str) -> str:
    """The text up to where ``stop`` begins, all of it where that is nowhere."""
    end = re.search(stop, text, re.I)
    return text[: end.start() if end else len(text)].strip()


def lookup_entity(part: str) -> str | None:
    """What the part asks about, if it asks about something by name."""
    asked = [m[1] for m in (re.search(about, part, re.I) for about in ABOUT) if m]
    return (before(asked[0], GOES_ON) or None) if asked else None


def compare_entities(question: str) -> tuple[str, ...]:
    """The things that the question wants to see next to each other."""
    _, *named = re.split(COMPARED, question, maxsplit=1, flags=re.I)
    every = re.split(BETWEEN_COMPARED, named[0], flags=re.I) if named else []
    return tuple(filter(None, map(str.strip, every)))[:MAX_ENTITIES]


def asks_both_genders(question: str) -> bool:
    """Whether the question wants numbers of women and of men."""
    asked = normalize(question)
    return all(re.search(p, asked) for p in (WOMEN, MEN)) and any(map(asked.__contains__, HOW_MANY))


def plan_by_rule(question: str) -> list[Task]:
    if "so sanh" in normalize(question) and (entities := compare_entities(question)):
        return [Task("compare", question, entities=entities)]
    both = asks_both_genders(question)
    tasks = []
    for part in (p.strip() for p in re.split(BETWEEN_PARTS, question)):
        if not part:
            continue
        if entity := lookup_entity(part):
            tasks.append(Task("lookup", part, entity=entity))
            continue
        kind = next((k for k, p in PART_RULES if (k != "gender" or both) and re.search(p, normalize(part))), None)
        if kind in ("count", "sum", "avg", "max", "min"):
            tasks.append(Task("aggregate" if kind != "count" else "count", part, op=kind))
        elif kind in ("oldest", "youngest"):
            tasks.append(Task(kind, part))
    return tasks + ([Task("gender_count", question)] if both else [])


def schema_summary(schema: list[ColumnProfile]) -> list[dict]:
    """What a model is told about a table: MAX_COLUMNS columns at most, MAX_SAMPLES values of each."""
    about = lambda c: {"name": c.name, "title": c.original_name, "type": c.dtype, "meaning": c.semantic_type, "samples": c.samples[:MAX_SAMPLES]}
    return [about(c) for c in schema[:MAX_COLUMNS]]


def planner_prompt(question: str, schema: list[ColumnProfile]) -> str:
    """A prompt for a model's plan, as ``plan_by_model`` reads it."""
    shapes = [
        {"type": "lookup", "entity": "..."}, {"type": "count", "filters": [{"field": "...", "op": "|".join(OPS), "value": "..."}]}, {"type": "group_count", "group_by": "..."},
        {"type": "aggregate", "op": "sum|avg|min|max|count", "target": "...", "filters": []}, {"type": "extreme", "direction": "asc|desc", "target": "...", "filters": []},
        {"type": "compare", "entities": ["..."]},
    ]
    return (
        "Turn the question about a table into a JSON plan, without SQL and without explanations. Name columns by the question's own words. "
        f"Use a task for each thing asked, in the question's order, {MAX_TASKS} at most, of these types:\n" + json.dumps({"tasks": shapes}, ensure_ascii=False)
        + f"\n\nColumns:\n{json.dumps(schema_summary(schema), ensure_ascii=False)}\n\nQuestion: {question}\n"
    )


def plan_by_model(answer: str | dict | None, question: str) -> list[Task]:
    """A model's plan, checked: unknown tasks, operators and surplus entries are left out."""
    if isinstance(answer, str):
        found = re.search(r"\{.*\}", answer, re.S)
        try:
            answer = json.loads(found[0]) if found else None
        except ValueError:
            answer = None
    raw = answer.get("tasks", []) if isinstance(answer, dict) else []
    kinds = {"lookup": "lookup", "lookup_entity": "lookup", "count": "count", "count_rows": "count", "group_count": "group_count", "aggregate": "aggregate", "extreme": "extreme", "compare": "compare"}
    out = []
    for item in raw[:MAX_TASKS] if isinstance(raw, list) else []:
        if not isinstance(item, dict) or item.get("type") not in kinds:
            continue
        text = lambda k: str(item[k])[:120] if isinstance(item.get(k), str) and item[k].strip() else None
        filters = [f for f in item.get("filters") or [] if isinstance(f, dict) and f.get("op") in OPS and f.get("field") and f.get("value") not in (None, "")]
        entities = tuple(str(e)[:120] for e in (item.get("entities") or [])[:MAX_ENTITIES])
        op = item.get("op") if item.get("op") in ("sum", "avg", "min", "max", "count") else None
        out.append(Task(kinds[item["type"]], question, text("entity"), entities, text("target"), text("group_by"), op, item.get("direction") if item.get("direction") in ("asc", "desc") else None, tuple(filters[:MAX_FILTERS])))
    return out


# ── binding to columns ──────────────────────────────────────────────────────


def score(column: ColumnProfile, question: str, kinds: frozenset[str] = frozenset()) -> int:
    """100 x confidence for a wanted meaning, 80 for the name, 50 for each alias, 8 for each word found."""
    norm, short = normalize(question), compact(question)
    name = normalize(column.original_name or column.name)
    described = normalize(" ".join([column.name, column.original_name, column.semantic_type, *column.aliases, *column.samples[:5]]))
    total = int(column.confidence * 100) if column.semantic_type in kinds else 0
    total += 80 * bool(name and (name in norm or compact(name) in short))
    total += sum(50 for a in column.aliases if normalize(a) and normalize(a) in norm)
    return total + sum(8 for w in norm.split() if len(w) >= 3 and w in described)


def best_column(schema: list[ColumnProfile], question: str, kinds=(), *, numeric: bool = False, least: int = 60) -> ColumnProfile | None:
    ranked = sorted((-score(c, question, frozenset(kinds)), i) for i, c in enumerate(schema) if c.numeric or not numeric)
    return schema[ranked[0][1]] if ranked and -ranked[0][0] >= least else None


def resolve_hint(schema: list[ColumnProfile], hint: str | None, *, numeric: bool = False, least: int = 45) -> ColumnProfile | None:
    """The column that a plan's words mean: by its name, aliases and values, else by the name of a meaning in the words."""
    hint = (hint or "").strip()
    if not hint:
        return None
    if found := best_column(schema, hint, numeric=numeric, least=least):
        return found
    norm = normalize(hint)
    meant = (best_column(schema, hint, {kind}, numeric=numeric, least=50) for kind in ALIASES if not kind.startswith("generic") and normalize(kind) in norm)
    return next(filter(None, meant), None)


def column_of(schema: list[ColumnProfile], kinds: tuple[str, ...]) -> ColumnProfile | None:
    return next((c for k in kinds for c in schema if c.semantic_type == k), None)


# ── running tasks ───────────────────────────────────────────────────────────


def _c(column: ColumnProfile | str) -> Column:
    return F.col(T.quote_identifier(column if isinstance(column, str) else column.name))


def filters_to_condition(schema: list[ColumnProfile], filters, *, between: bool = False) -> Column:
    """AND of the filters.  Unknown fields search the row's text; numeric operators need numeric columns.

    ``between`` ([low, high]) is ignored unless asked for.
    """
    out = F.lit(True)
    for f in filters:
        column = best_column(schema, str(f["field"]), least=50)
        op, value = f["op"], f["value"]
        if op == "between":
            if between and column and column.numeric:
                out = out & _c(column).between(*value)
        elif column is None:
            out = out & T.contains_ignoring_case(F.col("search_text"), str(value))
        elif op == "contains":
            out = out & T.contains_ignoring_case(_c(column), str(value))
        elif op == "equals":
            out = out & (F.lower(_c(column).cast("string")) == str(value).replace("%", "").lower())
        elif column.numeric and (number := _number(value)) is not None:
            compare = {"gt": lambda c: c > number, "lt": lambda c: c < number, "gte": lambda c: c >= number, "lte": lambda c: c <= number}[op]
            out = out & compare(_c(column))
    return out


def _number(value) -> float | None:
    try:
        return float(str(value).strip())
    except ValueError:
        return None


def search(table: DataFrame, words: list[str]) -> DataFrame:
    return table.filter(T.contains_all(F.col("search_text"), words)).orderBy("_row_idx").limit(LIMIT)


def lookup(table: DataFrame, schema: list[ColumnProfile], entity: str, *, rows: int | None = FUZZY_ROWS) -> DataFrame:
    """Rows whose name or text contains the entity; else the row whose name is most like it (of the first ``rows``, of all if None)."""
    person = column_of(schema, ("person_name", "teacher"))
    hit = T.contains_ignoring_case(F.col("search_text"), entity)
    if person:
        hit = hit | T.contains_ignoring_case(_c(person), entity)
    found = table.filter(hit).orderBy("_row_idx").limit(LIMIT)
    if not found.isEmpty() or person is None:
        return found
    return most_similar(table if rows is None else table.orderBy("_row_idx").limit(rows), _c(person), entity)


def most_similar(table: DataFrame, name: Column, entity: str, *, least: float = FUZZY) -> DataFrame:
    """The row whose name is most like the entity (``similarity``), if it is like enough; of equals, the first.

    A ratio is 2 m / (length + length), m being characters in common order; the characters in common in any order, which
    built-in functions count, are never fewer.  Only names that can reach ``least`` by that are compared in Python.
    """
    asked, score = normalize(entity), fresh_name("similarity", table)
    if not asked:
        return table.limit(0)
    norm = T.normalize_text(name)
    times = lambda c: F.length(norm) - F.length(F.replace(norm, F.lit(c), F.lit("")))
    common = reduce(lambda x, y: x + y, [F.least(times(c), F.lit(asked.count(c))) for c in sorted(set(asked))])
    within = (norm != "") & (norm.contains(F.lit(asked)) | F.lit(asked).contains(norm))
    hopeful = within | (2.0 * common >= F.lit(least - 1e-9) * (F.length(norm) + len(asked)))

    @F.pandas_udf("double")
    def ratio(names: pd.Series) -> pd.Series:
        return names.map(lambda n: similarity(entity, n))

    scored = table.filter(hopeful).withColumn(score, ratio(name.cast("string"))).filter(F.col(score) >= least)
    return scored.orderBy(F.desc(score), "_row_idx").limit(1).drop(score)


def similarity(left: str | None, right: str | None) -> float:
    a, b = normalize(left), normalize(right)
    if not a or not b:
        return 0.0
    return 1.0 if a in b or b in a else SequenceMatcher(None, a, b).ratio()


def count_rows(table: DataFrame, condition: Column | None = None) -> DataFrame:
    return (table if condition is None else table.filter(condition)).agg(F.count("*").alias("n"))


def aggregate(table: DataFrame, column: ColumnProfile, op: str, condition: Column | None = None) -> DataFrame:
    rows = table if condition is None else table.filter(condition)
    return rows.agg({"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}[op](_c(column)).alias(op))


def named_columns(schema: list[ColumnProfile], question: str, most: int = 3) -> list[ColumnProfile]:
    """The numeric columns that the question names, in its order, ``most`` at most."""
    short = compact(question)
    places = [(short.find(compact(c.original_name or c.name)), i) for i, c in enumerate(schema) if c.numeric and compact(c.original_name or c.name)]
    return [schema[i] for place, i in sorted(p for p in places if p[0] >= 0)[:most]]


def aggregate_named(table: DataFrame, schema: list[ColumnProfile], question: str, op: str, condition: Column | None = None) -> DataFrame | None:
    """One row with the aggregate of each column that the question names, or None where it names none."""
    columns = named_columns(schema, question)
    rows = table if condition is None else table.filter(condition)
    f = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}[op]
    return rows.agg(*[f(_c(c)).alias(f"{op}_{c.name}") for c in columns]) if columns else None


def group_count(table: DataFrame, column: ColumnProfile | str, condition: Column | None = None) -> DataFrame:
    rows = table if condition is None else table.filter(condition)
    key = _c(column)
    return rows.filter(key.isNotNull()).groupBy(key.alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(LIMIT)


def gender_count(table: DataFrame, column: ColumnProfile) -> DataFrame:
    norm = T.normalize_text(_c(column))
    one = lambda *labels: F.sum(F.when(norm.isin(*labels), 1).otherwise(0))
    return table.agg(one("nam", "male", "m").alias("Nam"), one("nu", "female", "f").alias("Nữ"))


def value_count(table: DataFrame, schema: list[ColumnProfile], question: str) -> DataFrame | None:
    """The count of the value (of a text column) that the question names: of several the one of most words, then of the
    column that fits the question best.  One pass over the table; only values in the question are grouped."""
    columns = [c.name for c in schema if c.dtype == "TEXT"]
    if not columns:
        return None
    order = sorted(range(len(columns)), key=lambda i: (-score(next(c for c in schema if c.name == columns[i]), question), i))
    place = F.create_map(*[F.lit(x) for at, i in enumerate(order) for x in (columns[i], at)])
    norm = T.normalize_text(F.col("value"))
    asked = F.lit(f" {normalize(question)} ")
    cells = unpivoted(table, columns).select("column", norm.alias("norm")).filter((F.col("norm") != "") & asked.contains(F.concat(F.lit(" "), "norm", F.lit(" "))))
    counts = cells.groupBy("column", "norm").agg(F.count("*").alias("n"))
    best = counts.orderBy(F.desc(F.size(F.split("norm", " "))), place[F.col("column")], "norm").limit(1).select("n")
    return None if best.isEmpty() else best


def by_age(table: DataFrame, schema: list[ColumnProfile], oldest: bool, condition: Column | None = None) -> DataFrame | None:
    """The oldest (youngest) row by age, else by birth year, else by date of birth; ties by row."""
    rows = table if condition is None else table.filter(condition)
    if column := column_of(schema, ("age",)):
        key, descending = T.to_float(_c(column)), oldest
    elif column := next((c for c in schema if c.semantic_type == "birth_year" and c.numeric), None):
        key, descending = T.to_float(_c(column)), not oldest
    elif column := column_of(schema, ("date_of_birth", "birth_year")):
        year = F.when(T.looks_like_year(_c(column)), F.make_date(_c(column).try_cast("int"), F.lit(1), F.lit(1)).cast("timestamp"))
        key, descending = F.coalesce(T.parse_date(_c(column)), year), not oldest
    else:
        return None
    keyed = rows.withColumn("_key", key).filter("_key IS NOT NULL")
    return keyed.orderBy(F.desc("_key") if descending else F.asc("_key"), "_row_idx").limit(1).drop("_key")


def extreme(table: DataFrame, column: ColumnProfile, direction: str, condition: Column | None = None) -> DataFrame:
    rows = table if condition is None else table.filter(condition)
    order = F.desc_nulls_last(T.quote_identifier(column.name)) if direction == "desc" else F.asc_nulls_last(T.quote_identifier(column.name))
    return rows.orderBy(order, "_row_idx").limit(1)


def analysis(table: DataFrame, schema: list[ColumnProfile]) -> dict[str, DataFrame]:
    """Total, first distinct values of 3 text columns, range and mean of 5 numeric ones, 5 rows."""
    texts = [c for c in schema if c.dtype == "TEXT"][:3]
    numbers = [c for c in schema if c.numeric][:5]
    out = {"total": count_rows(table), "rows": table.orderBy("_row_idx").limit(5)}
    for c in texts:
        out[f"values:{c.name}"] = table.select(_c(c).alias("value")).filter("value IS NOT NULL AND value <> ''").distinct().orderBy("value").limit(10)
    if numbers:
        aggregates = [F.array(F.min(_c(c)).cast("double"), F.max(_c(c)).cast("double"), F.avg(_c(c))).alias(c.name) for c in numbers]
        out["numbers"] = table.agg(*aggregates)
    return out


def run(table: DataFrame, schema: list[ColumnProfile], task: Task) -> DataFrame | None:
    condition = filters_to_condition(schema, task.filters) if task.filters else None
    if task.kind == "lookup":
        return lookup(table, schema, task.entity or task.text)
    if task.kind == "compare":
        parts = [lookup(table, schema, e) for e in task.entities]
        return reduce(lambda a, b: a.unionByName(b), parts) if parts else None
    if task.kind in ("oldest", "youngest"):
        words = keywords(task.text, FILTER_WORDS)
        held = T.contains_all(F.col("search_text"), words) if words else None
        return by_age(table, schema, task.kind == "oldest", held)
    if task.kind == "gender_count":
        column = column_of(schema, ("gender",))
        return gender_count(table, column) if column else None
    words = search_keywords(keywords(task.text, FILTER_WORDS))
    codes = [w for w in words if is_code(w)]
    if task.kind == "count":
        if condition is not None:
            return count_rows(table, condition)
        found = value_count(table, schema, task.text)
        if found is not None or (words and not codes):  # words that name no value: nobody knows what to count
            return found
        return count_rows(table, T.contains_all(F.col("search_text"), codes) if codes else None)
    if task.kind == "group_count":
        column = resolve_hint(schema, task.group_by) or best_column(schema, task.text, least=50)
        return group_count(table, column, condition) if column else None
    if task.kind == "extreme" and any(word in normalize(task.target) for word in AGE_WORDS):
        return by_age(table, schema, (task.direction or "desc") == "desc", condition)
    if task.kind in ("aggregate", "extreme"):
        column = resolve_hint(schema, task.target, numeric=True) or best_column(schema, task.target or task.text, ("age", "credit", "quantity", "generic_number"), numeric=True)
        if column is None:
            return None
        if task.kind == "extreme":
            return extreme(table, column, task.direction or "desc", condition)
        if condition is None and codes:
            condition = T.contains_all(F.col("search_text"), codes)
        return aggregate(table, column, task.op or "sum", condition)
    return None


def title(task: Task) -> str:
    """What stands above a task's result."""
    about = task.entity or task.text if task.kind == "lookup" else task.group_by or GROUP
    return TITLES.get(task.kind, TITLE).format(about)


def by_intent(table: DataFrame, schema: list[ColumnProfile], question: str, kind: str) -> DataFrame | None:
    """The question's words looked up, counted, or an aggregate of the columns it names in the rows that hold its codes."""
    words = search_keywords(keywords(question))
    held = T.contains_all(F.col("search_text"), words) if words else None
    if kind == "LOOKUP":
        return search(table, words) if words else None
    if kind == "COUNT":
        return count_rows(table, held).filter("n > 0")
    if kind in ("SUM", "AVG", "MIN", "MAX"):
        codes = [w for w in words if is_code(w)]
        return aggregate_named(table, schema, question, kind.lower(), T.contains_all(F.col("search_text"), codes) if codes else None)
    return None


def answer(
    table: DataFrame, question: str, schema: list[ColumnProfile] | None = None, planner: Planner | None = None, sql_model: Model | None = None,
) -> str | None:
    """Markdown of the answer, or None where nothing was found.

    In this order: an overview, where one is asked for; the plan (a model's, else by rule), each task's result under its
    title; what the question's intent says (``by_intent``); SQL that a model writes.
    """
    kind = intent(question)
    if kind == "NONE":
        return None
    schema = schema or profile_table(table)
    if kind == "ANALYSIS":
        return "\n\n".join(f"{name}\n{render(frame)}" for name, frame in analysis(table, schema).items())
    tasks = plan_by_model(planner(question, schema), question) if planner else []
    parts = [f"{title(t)}\n{text}" for t in tasks or plan_by_rule(question) if (text := _shown(run(table, schema, t)))]
    if parts:
        return "\n\n".join(parts)
    found = _shown(by_intent(table, schema, question, kind))
    if found is None and sql_model and kind not in ("COUNT", "SUM", "AVG", "MIN", "MAX"):
        found = answer_by_sql(table, question, schema, sql_model)
    return found


def _shown(frame: DataFrame | None) -> str | None:
    """A result as Markdown; None where there is none, or nothing but nulls."""
    if frame is None:
        return None
    rows = frame.limit(LIMIT).collect()
    return _markdown(frame.columns, rows) if any(v is not None for r in rows for v in r) else None


def answer_any(tables: list[DataFrame], question: str, planner: Planner | None = None, sql_model: Model | None = None) -> str | None:
    """The first table with an answer wins."""
    return next((a for t in tables if (a := answer(t, question, planner=planner, sql_model=sql_model))), None)


def render(frame: DataFrame) -> str:
    """A result of at most LIMIT rows as a Markdown table; bookkeeping columns are hidden."""
    return _markdown(frame.columns, frame.limit(LIMIT).collect())


def _markdown(columns: list[str], rows: list[Row], most: int = 5000) -> str:
    shown = [i for i, c in enumerate(columns) if c not in ("_row_idx", "search_text")]
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(columns[i] for i in shown) + " |", "| " + " | ".join("---" for _ in shown) + " |"]
    lines += ["| " + " | ".join(cell(r[i]) for i in shown) + " |" for r in rows]
    return "\n".join(lines)[:most]


# ── SQL that a model wrote ──────────────────────────────────────────────────

FORBIDDEN = ("insert", "update", "delete", "drop", "alter", "create", "truncate", "merge", "grant", "revoke")


#: Quoted parts of SQL, which are left alone.
_QUOTED = r"('(?:[^']|'')*'|`[^`]*`|\"[^\"]*\")"


def fix_sql(sql: str, columns: list[str]) -> str:
    """Column names in their own case, ILIKE for LIKE, and a LIMIT but for one row of aggregates; literals stay."""
    parts = re.split(_QUOTED, sql)
    for i in range(0, len(parts), 2):
        for c in sorted(columns, key=len, reverse=True):
            parts[i] = re.sub(rf"(?<![\w`]){re.escape(c)}(?![\w`])", T.quote_identifier(c).replace("\\", r"\\"), parts[i], flags=re.I)
        parts[i] = re.sub(r"\bLIKE\b", "ILIKE", parts[i], flags=re.I)
    code = " ".join(parts[::2])
    one_row = re.search(r"\b(count|sum|avg|min|max)\s*\(", code, re.I) and not re.search(r"\bgroup\s+by\b|\bover\s*\(", code, re.I)
    sql = "".join(parts).strip().rstrip(";")
    return sql if one_row or re.search(r"\blimit\s+\d+", code, re.I) else f"{sql} LIMIT {LIMIT}"


def check_sql(sql: str) -> str:
    """``sql``, if it is one SELECT; words in literals and quoted names do no harm."""
    code = " ".join(re.split(_QUOTED, sql)[::2])
    if not re.match(r"\s*(select|with)\b", sql, re.I) or re.search(rf"\b({'|'.join(FORBIDDEN)})\b|;\s*\S", code, re.I):
        raise ValueError("only a single SELECT may run")
    return sql


def run_sql(table: DataFrame, sql: str, name: str = "t") -> DataFrame:
    """The result of a checked SELECT in which ``{t}`` stands for the table; Spark analyses it here and runs it when asked for rows."""
    return table.sparkSession.sql(check_sql(fix_sql(sql, table.columns)), **{name: table})


def sql_prompt(question: str, schema: list[ColumnProfile]) -> str:
    """A prompt for SQL, as ``run_sql`` runs it."""
    columns = "\n".join(f"{T.quote_identifier(c.name)} {c.dtype}, such as {', '.join(c.samples[:3])}" for c in schema[:MAX_COLUMNS])
    return (
        "Write one Spark SQL SELECT that answers the question, and nothing else. The table is {t}; its columns are\n"
        f"`_row_idx` INTEGER, the place of a row\n{columns}\n`search_text` TEXT, all cells of a row\n"
        f"Compare texts with ILIKE '%...%', order single rows by `_row_idx`, and give {LIMIT} rows at most.\n\nQuestion: {question}\nSQL:"
    )


def answer_by_sql(table: DataFrame, question: str, schema: list[ColumnProfile], model: Model, attempts: int = ATTEMPTS) -> str | None:
    """What the SQL of a model finds.  SQL that Spark cannot analyse or run goes back to the model with the error, ``attempts`` times in all."""
    prompt = sql_prompt(question, schema)
    for _ in range(attempts):
        try:
            sql = re.sub(r"^\s*```\w*\s*|\s*```\s*$", "", model(prompt))
            return _shown(run_sql(table, sql))
        except (PySparkException, ValueError, KeyError, IndexError) as failed:  # the last two: braces that name nothing
            prompt += f"\n\nThis SQL failed:\n{sql}\n{str(failed)[:200]}\nCorrect it.\nSQL:"
    return None
