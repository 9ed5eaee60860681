import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortry import checkpoint
from cohortry.operators import concepts as K
from cohortry.sources import extract as E
from cohortry.sources import io, specs


@pytest.fixture()
def table(spark, tmp_path):
    name = "t_" + tmp_path.name.replace("-", "_")
    yield name, str(tmp_path / "data")
    io.drop_table(spark, name)


def test_save_refuses_and_replaces(spark, frame, rows, table):
    name, path = table
    df = frame([(1, "a")], "k int, v string")
    assert io.save_table(df, name, path=path) and not io.save_table(df, name)
    assert rows(io.scan(spark, name)) == [(1, "a")]
    assert io.save_table(frame([(2, "b")], "k int, v string"), name, replace=True, path=path + "2")
    assert rows(io.scan(spark, name, "k = 2")) == [(2, "b")] and name in io.list_tables(spark)


def test_append_aligns_columns_by_name(spark, frame, rows, table):
    name, path = table
    assert not io.append_table(frame([(1,)], "k int"), name)
    io.save_table(frame([(1, "a")], "k int, v string"), name, path=path)
    assert io.append_table(frame([("b", 2)], "v string, k int"), name)
    assert rows(spark.table(name)) == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError):
        io.append_table(frame([(1, "x", 2)], "k int, w string, z int"), name)


def test_materialize_and_purge(spark, frame, rows, tmp_path):
    df = io.materialize(frame([(1,)], "k int"), path=str(tmp_path / "c"))
    assert rows(df) == [(1,)]
    assert not any(n.startswith(io.CACHE_PREFIX) for n in io.list_tables(spark))
    assert io.purge_cache(spark) and not io.purge_cache(spark)
    assert rows(checkpoint(frame([(2,)], "k int"))) == [(2,)]


def test_json_and_csv_use_the_given_schema(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"k": 1, "x": 2}\n')
    (tmp_path / "a.csv").write_text("k,v\n1,z\n")
    assert io.read_json(spark, str(tmp_path / "a.json"), "k int, gone string").first() == (1, None)
    assert io.read_csv(spark, str(tmp_path / "a.csv"), "k int, v string").first() == (1, "z")


@pytest.fixture(scope="module")
def tables(frame):
    d = dt.date
    return {
        "encounter": frame([("p", 1, "e1", d(2020, 1, 1), "x"), ("p", 2, "e2", d(2020, 1, 2), "y")], "pat_id string, instance int, pat_enc_csn_id string, contact_date date, department_id string"),
        "encounterdiagnosis": frame([("p", 1, "e1", "d1", "note"), ("p", 1, "e1", "d2", "note")], "pat_id string, instance int, pat_enc_csn_id string, dx_id string, pat_enc_date_real string"),
        "department": frame([("x", 1, "Ward")], "department_id string, instance int, name string"),
        "medicationorders": frame([("p", 1, "m1", 7, d(2020, 5, 1))], "pat_id string, instance int, order_med_id string, medication_id int, ordering_datetime date"),
        "medication": frame([(7, 1, "drug"), (7, 2, "other")], "medication_id int, instance int, short_name string"),
        "flowsheet": frame([("p", 1, "f1", "i1")], "pat_id string, instance int, fsd_id string, inpatient_data_id string"),
        "flowsheetentry": frame([("f1", 1, "i1", "q", d(2020, 1, 1), "98")], "fsd_id string, instance int, inpatient_data_id string, flo_meas_id string, recorded_time date, value string"),
        "flowsheetdefinition": frame([("q", 1, "temp")], "flo_meas_id string, instance int, name string"),
        "conceptmapping": frame([("q", 1, "C1"), ("q", 2, "C2")], "flo_meas_id string, instance int, code string"),
    }


def test_extract_keeps_cohort_rows_and_source_system(frame, tables, rows):
    people = frame([("p", 1, dt.date(1990, 1, 1), "f"), ("q", 1, dt.date(1991, 1, 1), "m")], "pat_id string, instance int, birth_date date, sex string")
    spec = specs.encounters(tables, {"encounterdiagnosis": ["pat_enc_date_real"]})
    r = E.extract(people, spec, keep=["birth_date"], join="encounterdiagnosis")
    assert "pat_enc_date_real" not in r.columns and "sex" not in r.columns
    assert rows(r.select("pat_id", "dx_id", "name", "age_at_contact_dt")) == [("p", "d1", "Ward", 30.0), ("p", "d2", "Ward", 30.0), ("q", None, None, None)]
    assert spec.default_omit(["encounterdiagnosis"]) == ["pat_enc_date_real"] and spec.default_omit() == []
    with pytest.raises(ValueError):
        spec.default_omit(["nope"])
    with pytest.raises(ValueError):
        E.extract(people, spec, keep=["height"])


def test_other_specs(tables, frame, rows):
    people = frame([("p", 1)], "pat_id string, instance int")
    assert rows(E.extract(people, specs.medication_orders(tables)).select("order_med_id", "short_name")) == [("m1", "drug")]
    assert rows(E.extract(people, specs.flowsheets(tables), where="value > 97").select("name", "code")) == [("temp", "C1")]


def test_person_sets(frame, rows):
    p, race = frame([("a", 1), ("a", 2), ("b", 1)], "pat_id string, instance int"), frame([("a", 1, "y"), ("a", 1, "x"), ("a", 1, "x"), ("a", 2, "z")], "pat_id string, instance int, race string")
    assert rows(E.person_cohort(p, race, ["pat_id", "instance"], "race")) == [("a", 1, ["x", "y"]), ("a", 2, ["z"]), ("b", 1, None)]


def test_registry_and_expansion(frame, rows):
    reg = frame([("l1", "A"), ("l2", "A"), ("l2", "Q")], "label string, code string")
    with pytest.raises(ValueError):
        K.registry(reg, ["l1", "zz"])
    concept = frame([(1, "A", "top", "S"), (2, "B", "mid", "S"), (3, "C", "low", "S"), (9, "A", "other", "T")], "concept_id int, concept_code string, concept_name string, vocabulary_id string")
    closure = frame([(1, 1), (1, 2), (1, 3), (2, 3)], "ancestor_concept_id int, descendant_concept_id int")
    found = K.codes(reg, concept, "S")
    assert rows(found.select("label", "concept_id")) == [("l1", 1), ("l2", 1), ("l2", None)]
    wide = K.expand_descendants(found, concept, closure)
    assert rows(wide.where("label = 'l1'").select("code")) == [("A",), ("B",), ("C",)]
    ids = frame([("x", 1, "S#B"), ("x", 2, "T#B"), ("y", 1, "S#C")], "value string, instance int, concept string")
    assert rows(K.to_source_ids(wide.where("label = 'l1'"), ids, "S")) == [("l1", "x", 1), ("l1", "y", 1)]


def test_flags_are_never_null(frame, rows):
    df = frame([("x", 1), ("x", 2), (None, 1)], "id string, instance int")
    ids = frame([("x", 1, "a"), ("x", 1, "b"), ("x", 2, "b")], "id string, instance int, label string")
    assert rows(K.add_flags(df, ids, ["id", "instance"], ["a", "b", "c"])) == [("x", 1, True, True, False), ("x", 2, False, True, False), (None, 1, False, False, False)]
    wide = frame([("x", True, None)], "id string, C_1 boolean, C_2 boolean")
    got = K.add_flags_wide(df.select("id").distinct(), wide, {"p": ["1", "9"], "q": ["2"], "r": ["9"]}, ["id"], "C_")
    assert rows(got) == [("x", True, False, False), (None, False, False, False)]


def test_values_text_and_harmonised_codes(frame, rows):
    df = frame([(1, ["A", "B"], "5"), (2, ["Z"], "6"), (3, None, "7")], "k int, codes array<string>, v string")
    reg = frame([("l", "B"), ("m", "Z")], "label string, code string")
    assert rows(K.add_values(df, reg, "codes", "v", ["l", "m"]).select("k", "l", "m")) == [(1, "5", None), (2, None, "6"), (3, None, None)]
    text = frame([("SARS PCR", "NAAT", 1), ("SARS PCR", None, 2), ("flu", "NAAT", 3)], "name string, kind string, v int")
    assert rows(K.add_text_concept(text, {"name": ["SARS", "COV"], "kind": ["NAAT"]}, "v", "hit").select("v", "hit")) == [(1, 1), (2, None), (3, None)]
    labs = frame([("a", "X1-2", None), ("a", None, "3-4"), ("b", None, None)], "name string, code string, fallback string")
    assert rows(K.harmonise_codes(labs, "name", "code", "fallback").select("name", "codes")) == [("a", ["1-2", "3-4"]), ("a", ["1-2", "3-4"]), ("b", [])]


def test_flagged_facts_keep_the_cohort(frame, rows):
    cohort, facts = frame([("p",), ("q",)], "k string"), frame([("p", ["d1", "d2"], "open"), ("q", ["d1"], "Deleted")], "k string, ids array<string>, status string")
    ids = frame([("d1", "a"), ("d3", "b")], "dx string, label string")
    r = E.flagged_facts(cohort, facts, ["k"], ids, ["dx"], ["a", "b"], "status <> 'Deleted'", "ids")
    assert rows(r.select("k", "dx", "a", "b")) == [("p", "d1", True, False), ("q", None, None, None)]


def test_specs_leave_columns_out_by_default(frame):
    tables = {"encounter": frame([("a", 1, "e", "high", "x")], "pat_id string, instance int, pat_enc_csn_id string, acuity string, kind string"), "notes": frame([("a", 1, "e", "u", "n")], "pat_id string, instance int, pat_enc_csn_id string, author_user_id string, note string")}
    seen = lambda spec: set(E.extract(None, spec, join="notes").columns) - {"pat_id", "instance", "pat_enc_csn_id"}
    assert seen(specs.encounters(tables)) == {"kind", "note"}
    assert seen(specs.encounters(tables, {})) == {"kind", "note", "acuity", "author_user_id"}
    assert seen(specs.encounters(tables, {"notes": ["note"]})) == {"kind", "acuity", "author_user_id"}
    assert specs.encounters(tables).default_omit(["notes"])[-3:] == ["author_provider_type", "author_user_id", "entry_user_id"]
