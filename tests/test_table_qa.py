import random

import pytest
from pyspark.sql import functions as F

from docquarry.plans import profile, table_qa
from docquarry.sources import tabular


def make(spark, columns, rows):
    types = ", ".join(f"{c} {t}" for c, t in columns)
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"_row_idx long, {types}")
    return tabular.with_search_text(table, [c for c, _ in columns])


def people(spark):
    rows = [("Trần Văn A", "Thạc sĩ", 1970, 3), ("Lê Thị B", "Tiến sĩ", 1965, 2), ("Phạm Văn C", "Thạc sĩ", 1990, 4), ("Ngô D E", "Cử nhân", 1999, 1)]
    return make(spark, [("Ho_ten", "string"), ("Trinh_do", "string"), ("Nam_sinh", "int"), ("TC", "int")], rows)


def test_profiles(spark):
    kinds = {p.name: p.semantic_type for p in profile.profile_table(people(spark))}
    assert kinds == {"Ho_ten": "person_name", "Trinh_do": "degree", "Nam_sinh": "birth_year", "TC": "credit"}


def test_oldest_and_youngest_by_birth_year(spark):
    assert "Trần Văn A" in table_qa.answer(people(spark), "thạc sĩ nào lớn tuổi nhất")
    assert "Phạm Văn C" in table_qa.answer(people(spark), "thạc sĩ nào trẻ nhất")


def test_lookup_with_a_typo(spark):
    found = table_qa.answer(people(spark), "cho tôi thông tin về Phạm Văm C")
    assert "Phạm Văn C" in found and "Trần" not in found


def test_gender_counts_and_groups(spark):
    table = make(spark, [("Ho_va_ten", "string"), ("Gioi_tinh", "string")], [("Lê A B", "Nam"), ("Lê C D", "Nữ"), ("Lê E F", "Nam"), ("Lê G H", "Nữ")])
    assert "| 2 | 2 |" in table_qa.answer(table, "có bao nhiêu nam và bao nhiêu nữ")
    plan = lambda q, s: '```json {"tasks": [{"type": "group_count", "group_by": "giới tính"}, {"type": "drop"}]} ```'
    assert "| Nam | 2 |" in table_qa.answer(table, "mỗi giới tính", planner=plan)


def test_count_of_a_named_value_is_not_a_substring(spark):
    gender = make(spark, [("Ho_va_ten", "string"), ("Gioi_tinh", "string")], [(f"Người {i}", "Nam" if i < 45 else "Nữ") for i in range(50)])
    assert "| 45 |" in table_qa.answer(gender, "có bao nhiêu nam")


def test_no_age_column_no_answer(spark):
    assert table_qa.answer(make(spark, [("Ten", "string"), ("TC", "int")], [("Toán", 3)]), "ai lớn tuổi nhất") is None


def test_intents_keywords_and_sql():
    assert table_qa.intent("tổng quan dữ liệu") == "SUM" and table_qa.intent("so sánh hai lớp") == "COMPARE"
    assert table_qa.search_keywords(table_qa.keywords("môn INT2204 và toán 12")) == ["int2204"]
    assert table_qa.compare_entities("so sánh A và B với C") == ("A", "B", "C")
    assert table_qa.fix_sql("select ten from {t} where TEN like '%a%'", ["Ten"]) == "select `Ten` from {t} where `Ten` ILIKE '%a%' LIMIT 200"
    for bad in ("drop table x", "select 1; delete from x"):
        try:
            table_qa.check_sql(bad)
            raise AssertionError(bad)
        except ValueError:
            pass


def test_sql_runs(spark):
    assert table_qa.run_sql(people(spark), "select Ho_ten from {t} where ho_ten like '%văn%'").count() == 2


def test_model_plan_is_checked():
    raw = {"tasks": [{"type": "count", "filters": [{"field": "x", "op": "gt", "value": 1}, {"field": "x", "op": "evil", "value": 1}]}, {"type": "nope"}, 3]}
    tasks = table_qa.plan_by_model(raw, "q")
    assert [t.kind for t in tasks] == ["count"] and len(tasks[0].filters) == 1
    assert table_qa.plan_by_model("no json", "q") == []


def test_hints_titles_and_age_words(spark):
    table = people(spark)
    schema = profile.profile_table(table)
    assert table_qa.resolve_hint(schema, "birth year").name == "Nam_sinh" and table_qa.resolve_hint(schema, "unknown thing") is None
    assert table_qa.resolve_hint(schema, " ") is None and table_qa.resolve_hint(schema, "credit", numeric=True).name == "TC"
    plan = lambda q, s: {"tasks": [{"type": "extreme", "direction": "asc", "target": "tuổi"}, {"type": "group_count", "group_by": "Trinh do"}]}
    found = table_qa.answer(table, "hỏi gì đó", planner=plan)
    assert found.startswith("Kết quả tìm giá trị phù hợp:\n| Ho_ten") and "Ngô D E" in found and "\n\nThống kê theo Trinh do:\n| value | n |" in found
    assert "| Thạc sĩ | 2 |" in found and "Trần" not in found


def test_counts_by_value_code_and_nothing(spark):
    table = make(spark, [("Ten_mon", "string"), ("Khoa", "string"), ("TC", "int")], [("INT2204 Toán", "Tin", 3), ("INT2204 Lý", "Tin học", 2), ("Hoá", "Tin học", 4)])
    assert "| 2 |" in table_qa.answer(table, "có bao nhiêu tin học")  # the longer value wins
    assert "| 2 |" in table_qa.answer(table, "có bao nhiêu INT2204")
    assert table_qa.answer(table, "có bao nhiêu giáo sư") is None
    assert "| 5 |" in table_qa.answer(table, "tổng tc của INT2204") and "| 9 |" in table_qa.answer(table, "cộng TC")


def test_named_aggregates_and_overview(spark):
    table = make(spark, [("Ten", "string"), ("Diem_a", "int"), ("Diem_b", "int")], [("x", 3, 10), ("y", 5, 20)])
    assert table_qa.answer(table, "diem b và diem a dài nhất") == "| max_Diem_b | max_Diem_a |\n| --- | --- |\n| 20 | 5 |"
    overview = table_qa.answer(table, "lên kế hoạch")
    assert overview.startswith("total\n| n |") and "numbers\n" in overview


@pytest.mark.parametrize("wrong", ["select nowhere from {t}", "drop table t", "select {x} from {t}", "select cast('a' as int) from {t}", "no sql at all"])
def test_sql_has_a_second_attempt(spark, wrong):
    prompts = []
    replies = iter([wrong, "```sql\nselect Ho_ten from {t} where trinh_do like '%tiến%'\n```"])

    def model(prompt):
        prompts.append(prompt)
        return next(replies)

    table = people(spark)
    schema = profile.profile_table(table)
    assert "Lê Thị B" in table_qa.answer_by_sql(table, "ai là tiến sĩ", schema, model)
    assert len(prompts) == 2 and wrong in prompts[1] and prompts[1].startswith(prompts[0])


def test_sql_gives_up_after_two(spark):
    asked = []
    table = people(spark)
    assert table_qa.answer(table, "so sánh nhóm: nhiều hơn", sql_model=lambda p: asked.append(p) or "select nowhere from {t}") is None
    assert len(asked) == 2


def test_limit_and_literals():
    assert table_qa.fix_sql("select a, count(*) from {t} group by a;", ["a"]).endswith("LIMIT 200")
    assert table_qa.check_sql("select * from {t} where a = 'drop; delete'")
    assert len(table_qa.schema_summary([profile.ColumnProfile(f"c{i}", f"c{i}", "TEXT", samples=["x"] * 20) for i in range(90)])) == 60
    assert '"c1"' in table_qa.planner_prompt("q", [profile.ColumnProfile("c1", "c1", "TEXT")])


def test_most_similar_of_all_rows_equals_brute_force(spark):
    rng = random.Random(5)
    syllables = "nguyễn văn thị hoàng Trần lê an bình châu dũng ông".split()
    names = [" ".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(500)] + ["", None, "Phan Chu Trinh"]
    table = spark.createDataFrame(list(enumerate(names)), "_row_idx long, name string").repartition(4)
    for entity in ["phan chu trin", "nguyen vaan an", "hoang thi binhh chau", "zzz", "", "Trần Văm An", "le"]:
        best = max(((table_qa.similarity(entity, n), -i) for i, n in enumerate(names)), default=None)
        want = [-best[1]] if best[0] >= table_qa.FUZZY else []
        assert [r["_row_idx"] for r in table_qa.most_similar(table, F.col("name"), entity).collect()] == want, entity
