"""Profile, quality, plan, execution and KPIs over small dirty tables with known answers."""

import json
import re
import statistics
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

import fixtures_data as D
from conftest import ROOT
from tersa import (
    Analysis, Step, before_after, drop_empty_rows, execute_plan, fit_plan, guardrail, kpi_report,
    mask_by_hint, masked_sample, plan_from_json, plan_to_json, profile, profile_report,
    propose_plan, propose_steps, quality_issues, quality_overall, quality_scores, replay_plan,
    replay_stream, review, run_plan, scan_csv,
)
from tersa.operators import analysis as analysis_module
from tersa.operators.analysis import duplicate_rows
from tersa.operators.catalog import apply_operation
from tersa.plans.steps import collect_steps
from tersa.sources.checkpoints import drop_checkpoints, reliable_checkpoint
from tersa.sources.local import local_frame


@pytest.fixture
def load(spark, tmp_path):
    def make(content, purge=True):
        path = tmp_path / f"t{abs(hash(content))}.csv"
        path.write_text(content, encoding="utf-8")
        df = scan_csv(spark, str(path))
        return drop_empty_rows(df) if purge else df

    return make


def column(df, name):
    return [r[0] for r in df.select(name).collect()]


def by_name(df):
    return {r.column_name: r for r in df.collect()}


def test_profile_sales(load):
    a = Analysis(load(D.PROFILE_SALES))
    report = profile_report(a).first()
    assert (report.row_count, report.column_count, report.duplicates_count) == (4, 8, 1)
    assert report.duplicates_percentage == 25.0 and len(report.global_warnings) == 1
    p = by_name(profile(a))
    hints = {n: r.semantic_hint for n, r in p.items()}
    assert (hints["Fecha"], hints["ID_Cliente"], hints["Precio_Unidad"], hints["Nombre_Cliente"]) == (
        "date", "id", "currency", "name")
    assert (p["Fecha"].null_count, p["Fecha"].null_percentage) == (1, 25.0)
    assert p["Fecha"].warnings[0].startswith("Muchos nulos: 25.0%")
    assert p["Precio_Unidad"].inferred_type == "numeric"
    assert (p["Precio_Unidad"].min_value, p["Precio_Unidad"].max_value, p["Precio_Unidad"].median) == (45.0, 1200.5, 775.25)
    assert p["Canal"].sample_values == ["Web", "Tienda", "WEB"]


@pytest.mark.parametrize("values, expected", [
    (["50", "--", "N/D", "30", "—", "40", "15"], "numeric"),
    (["1", "2", "x", "y"], "numeric"),
    (["1", "x", "y"], "text"),
    (["N/D", "--"], "text"),
    (["si", "NO", "s"], "boolean"),
    (["2026-01-05", "2026-01-06", "06/01/2026", "invalid_date"], "datetime"),
    (["2026-01-05", "06/01/2026", "invalid_date"], "text"),
    (["a"] * 5 + ["b"] * 5, "categorical"),
    (["a"] * 5 + ["b"] * 2 + [None], "text"),
    ([None, " "], "text"),
])
def test_type_inference(texts, values, expected):
    assert by_name(Analysis(texts(values)).facts)["v"].inferred_type == expected


@pytest.mark.parametrize("name, values, hint", [
    ("correo", ["a@b.es", "x"], "email"), ("tasa_baja", ["5", "6"], "percentage"),
    ("x", ["5%", "6"], "percentage"), ("x", ["5 €", "6"], "currency"), ("monto", ["a"], "currency"),
    ("alta", ["a"], "date"), ("x", ["2026-01-05"] * 3, "date"), ("codigo", ["a"], "id"),
    ("x", ["AB-1", "hola"], "id"), ("movil", ["a"], "phone"), ("usuario", ["a"], "name"),
    ("city", ["a"], "location"), ("x", ["a"], "unknown"), ("email", [None, " "], "unknown"),
    ("Conversiones", ["120", "45"], "unknown"), ("CTR_Pct", ["3.2", "1.8"], "percentage"),
])
def test_semantic_hints(texts, name, values, hint):
    df = texts(values).withColumnRenamed("v", name)
    assert by_name(Analysis(df).facts)[name].semantic_hint == hint


def test_single_value_statistics(spark):
    df = spark.createDataFrame([(5.0, "k")], "x double, t string")
    row = by_name(profile(df))["x"]
    assert (row.mean, row.median, row.std) == (5.0, 5.0, 0.0)


def test_quality_contact_center(load):
    a = Analysis(load(D.CONTACT))
    issues = quality_issues(a).collect()
    found = {(r.column, r.kind): r for r in issues}
    assert {"uniqueness", "consistency", "integrity"} <= {r.dimension for r in issues}
    assert found[(None, "duplicates")].affected_rows == 1 and found[(None, "duplicates")].severity == "high"
    assert found[("Campana", "whitespace")].evidence_sample == [" Retencion ", " Retencion "]
    assert found[("Campana", "case")].affected_rows == 1
    assert found[("Fecha", "dates")].evidence_sample == ["02/02/2026"]
    assert found[("Score_Calidad", "percent_range")].evidence_sample == ["105.0"]
    assert found[("AHT_Segundos", "negatives")].evidence_sample == ["-50.0"]
    assert [r.issue_no for r in sorted(issues, key=lambda r: r.issue_no)] == list(range(1, len(issues) + 1))
    overall = quality_overall(a).first()
    scores = {r.dimension: r for r in quality_scores(a).collect()}
    assert all(0 <= r.score <= 100 for r in scores.values()) and 0 <= overall.overall_score <= 100
    assert scores["uniqueness"].score == 80.0 and scores["integrity"].score == 60.0
    assert overall.issues_count == len(issues)


def test_blank_cells_count_in_three_dimensions(spark):
    df = spark.createDataFrame([(str(i), "5") for i in range(3)] + [("3", "  ")], "i string, importe string")
    found = {(r.column, r.kind): r.affected_rows for r in quality_issues(df, evidence=False).collect()}
    assert {found[("importe", k)] for k in ("nulls", "whitespace", "numbers")} == {1}


def test_orders_end_to_end(load):
    df = load(D.ORDERS)
    a = Analysis(df)
    facts = by_name(a.facts)
    assert facts["Unidades_Stock"].inferred_type == "numeric" and facts["ID_Pedido"].semantic_hint == "id"
    steps = propose_steps(a)
    assert not [s for s in steps if s.column == "ID_Pedido" and s.operation == "normalize_case"]
    assert [s for s in steps if s.column == "Unidades_Stock" and s.operation == "convert_numeric"]
    done = execute_plan(df, steps)
    rows = {r.ID_Pedido: r for r in done.frame.collect()}
    assert sorted(rows) == [f"PED-20{i}" for i in range(1, 8)] and done.status == "completed"
    stock = [rows[k].Unidades_Stock for k in sorted(rows)]
    assert stock == [50.0, None, 30.0, 25.0, 40.0, 60.0, 15.0]
    names = {r.Razon_Social for r in rows.values()}
    assert {"Talleres Robles SLU", "Almacenes Pardo S.L.U.", "Distribuciones Marín S.L.U."} <= names
    assert rows["PED-204"].Descuento_Pct == 100.0 and rows["PED-202"].Dias_Entrega == 0.0
    assert rows["PED-202"].Fecha_Pedido == "2026-04-05" and rows["PED-205"].Fecha_Pedido is None
    better = before_after(a, done.frame).first()
    assert better.score_after > better.score_before and (better.rows_before, better.rows_after) == (8, 7)


def test_sales_end_to_end(load):
    raw = load(D.SALES, purge=False)
    steps = propose_steps(drop_empty_rows(raw), compat=True)
    done = execute_plan(raw, steps, purge_empty_rows=True)
    clean = done.frame.collect()
    assert len(clean) == 6 and not done.errors
    audit = {(r.operation, r.column): r for r in done.audit.collect()}
    purge = audit[("drop_empty_rows", None)]
    assert purge.modified == 1 and "1 fila(s) completamente vacías" in purge.message
    dates_row = audit[("convert_datetime", "Fecha")]
    assert dates_row.invalid == 1 and "formato inválido irrecuperable" in dates_row.message
    names = {r.Nombre_Cliente for r in clean}
    assert {"Soporte SA", "Luis Martinez", "Juan Pérez"} <= names
    assert dict(done.frame.dtypes)["Precio_Unidad"] == "double"
    assert all(float(r.Cantidad) >= 0 for r in clean if r.Cantidad not in (None, "Desconocido"))


def test_people_golden_values(load):
    df = load(D.PEOPLE)
    steps = propose_steps(df)
    proposed = {(s.column, s.operation) for s in steps}
    assert {("Nombre_Empleado", "normalize_case"), ("Horas_Mes", "convert_numeric"),
            ("Productividad_Pct", "clamp_range"), ("Absentismo_Dias", "clamp_range")} <= proposed
    done = execute_plan(df, steps)
    report = kpi_report(done.frame)
    kpis = {r.kpi_id: r for r in report.kpis.collect()}
    assert report.domain == "people_analytics" and done.frame.count() == 6
    assert kpis["kpi-avg-prod"].numeric_value in (88.2, 88.3)
    assert kpis["kpi-total-abs"].numeric_value == 3.0 and "3 días" in kpis["kpi-total-abs"].value
    assert kpis["kpi-emp-count"].value == "6 empleados"
    assert kpis["kpi-avg-prod"].change_direction == "positive"
    assert {r["category_name"]: r["count"] for r in report.breakdown.collect()}["Operaciones"] == 2
    assert report.narrative.count() == 1 and report.recommendations.count() == 0


def test_european_file(load):
    df = load(D.EUROPEAN)
    clean = execute_plan(df, propose_steps(df)).frame
    assert sorted(set(column(clean, "Salario_EUR"))) == [1200.5, 2500.0]
    assert min(column(clean, "Absentismo_Dias")) >= 0 and "2026-02-01" in column(clean, "Fecha")


def test_percent_clamps(load):
    df = load(D.PERCENT)
    steps = propose_steps(df)
    clamps = {s.column: s.parameters for s in steps if s.operation == "clamp_range"}
    assert clamps == {c: {"min_value": 0.0, "max_value": 100.0} for c in ("Incidencias_Pct", "Descuento_Pct")}
    clean = execute_plan(df, steps).frame.orderBy("ID")
    assert column(clean, "Incidencias_Pct") == [0.0, 15.5, 100.0, 0.0]
    assert column(clean, "Descuento_Pct") == [100.0, 0.0, 50.0, 100.0]


def test_campaign_counts_are_not_percentages(load):
    df = load(D.CAMPAIGNS)
    steps = propose_steps(df)
    assert not [s for s in steps if s.column == "Conversiones" and s.operation == "clamp_range"]
    clean = execute_plan(df, steps).frame.orderBy("Cod_Campana")
    assert column(clean, "Conversiones") == [120, 45, 210, 88, 22, 67, 180, 39]
    assert column(clean, "Cod_Campana") == [f"CAM-40{i}" for i in range(1, 9)]


def test_clamp_audit_labels(load):
    df = load(D.CLAMP)
    audit = execute_plan(df, propose_steps(df)).audit.collect()
    text = {r.column: r.message for r in audit if r.operation == "clamp_range"}
    assert "[0, inf]" in text["AHT_Segundos"] and "[0.0, 100.0]" in text["Score_Calidad"]
    assert {r.modified for r in audit if r.operation == "clamp_range"} == {1}


def test_sampled_rule_set_runs(load):
    df = load(D.SAMPLED)
    steps = propose_steps(df, ruleset="sampled")
    done = execute_plan(df, steps)
    assert steps and done.status == "completed" and done.frame.count() == 1


def test_destructive_rule_is_gated(texts):
    df = texts(["neurona", "eurocopa", "plan"])
    operations = [s.operation for s in propose_steps(df) if s.column == "v"]
    assert "convert_numeric" not in operations
    assert "convert_numeric" in [s.operation for s in propose_steps(df, compat=True) if s.column == "v"]


def test_fallback_rules(texts):
    df = texts(["AB-1", "CD-22", "hola"]).withColumn("saldo", F.col("i") - 1)
    steps = {(s.column, s.operation): s for s in propose_steps(df)}
    assert ("v", "normalize_case") in steps
    assert steps[("saldo", "clamp_range")].parameters == {"min_value": 0, "max_value": None}
    assert steps[("saldo", "clamp_range")].affected_rows_estimate == 1


def test_rejected_and_failing_steps(texts):
    steps = [
        Step("trim_text", "v", step_id="A"), Step("drop_column", "v", step_id="B"),
        Step("bogus", "v", step_id="C"), Step("trim_text", "nope", step_id="D"),
    ]
    done = execute_plan(texts([" x "]), review(steps, {"B": "rejected"}))
    assert done.status == "completed_with_errors" and column(done.frame, "v") == ["x"]
    status = {r.step_id: r.status for r in done.audit.collect()}
    assert status == {"A": "applied", "B": "omitted", "C": "error", "D": "error"}
    summary = done.summary().first()
    assert (summary.applied_steps, summary.skipped_steps, summary.failed_steps) == (1, 1, 2)
    assert summary.fingerprint_before != summary.fingerprint_after


def test_run_plan_writes_and_sums_up(spark, load, tmp_path):
    df = load(D.PEOPLE)
    steps = propose_steps(df)
    for kind in ("parquet", "csv"):
        done, summary = run_plan(df, steps, str(tmp_path / kind), kind)
        row = summary.first()
        assert (row.rows_before, row.rows_after, row.applied_steps) == (7, 6, len(steps))
        assert row.status == "completed" and row.seconds > 0 and row.path.endswith(kind)
    again = spark.read.parquet(str(tmp_path / "parquet"))
    assert again.exceptAll(done.frame).count() == 0


def test_modified_counts(texts):
    df = texts(["2", "1.200,50 €", "N/D", None])
    one = execute_plan(df, [Step("convert_numeric", "v")]).audit.first()
    assert one.modified == 2
    by_text = execute_plan(df, [Step("convert_numeric", "v")], compare="text").audit.first()
    assert by_text.modified == 3  # "2" becomes 2.0


def test_steps_after_rename_and_drop(spark):
    df = spark.createDataFrame([(" x ", "1,5", 1)], "a string, b string, c int")
    steps = [
        Step("rename_column", "a", {"new_name": "n"}), Step("trim_text", "n"), Step("drop_column", "c"),
        Step("rename_column", "b", {"new_name": "c"}), Step("convert_numeric", "c"),
        Step("clamp_range", "c", {"max_value": 1}), Step("trim_text", "a"),
    ]
    done = execute_plan(df, steps)
    assert done.frame.columns == ["n", "c"] and tuple(done.frame.first()) == ("x", 1.0)
    assert [s.target for s, _ in done.errors] == ["a"]


def test_plan_json_and_replay(load):
    df = load(D.PEOPLE)
    steps = propose_steps(df)
    text = plan_to_json(steps)
    assert plan_from_json(text) == steps and json.loads(text)[0]["step_id"] == "STEP-001"
    first, again = execute_plan(df, steps).frame, replay_plan(df, text).frame
    assert first.exceptAll(again).count() == 0


def test_checkpoint_keeps_the_result(spark, load):
    df = load(D.PEOPLE)
    steps = propose_steps(df)
    plain = execute_plan(df, steps)
    cut = execute_plan(df, steps, checkpoint=True)
    assert plain.frame.exceptAll(cut.frame).count() == 0
    assert sorted(map(str, plain.audit.collect())) == sorted(map(str, cut.audit.collect()))
    a = Analysis(df).materialize()
    assert quality_overall(a).first() == quality_overall(df).first()


def test_guardrail(load):
    plan = propose_plan(load(D.CLAMP))
    foreign = plan.limit(1).withColumn("operation", F.lit("run_script"))
    kept, dropped = guardrail(plan.unionByName(foreign))
    assert kept.count() == plan.count()
    assert [r.operation for r in dropped.collect()] == ["run_script"]
    assert len(collect_steps(kept)) == plan.count()


def test_masking(spark):
    rows = [(" Juan Pérez ", "juan.perez@empresa.com", "600123456", "1.200,50 €", "ver a@b.es"),
            ("María Gómez", "maria@corp.es", "+34 911 234 567", "N/D", "nada")]
    df = spark.createDataFrame(rows, "Nombre string, Email string, Telefono string, Importe string, Obs string")
    hints = {"Nombre": "name", "Email": "email", "Telefono": "phone", "Importe": "currency"}
    got = [tuple(r) for r in mask_by_hint(df, hints).collect()]
    assert got == [("[NOMBRE]", "[EMAIL]", "[TELÉFONO]", "1.200,50 €", "ver [EMAIL]"),
                   ("[NOMBRE]", "[EMAIL]", "[TELÉFONO]", "N/D", "nada")]
    ten = spark.range(10).selectExpr("id", "concat('Persona ', id) AS Nombre")
    assert masked_sample(ten, {"Nombre": "name", "id": "id"}, 3, "id").count() == 3


def test_contact_and_sales_kpis(load):
    df = load(D.CONTACT)
    report = kpi_report(execute_plan(df, propose_steps(df)).frame)
    kpis = {r.kpi_id: r for r in report.kpis.collect()}
    assert report.domain == "contact_center" and kpis["kpi-agents"].value == "4"
    assert kpis["kpi-aht"].value == "382.5 seg" and kpis["kpi-aht"].change_direction == "positive"
    assert (kpis["kpi-absenteeism"].value, kpis["kpi-absenteeism"].change_direction) == ("25.0%", "negative")
    sales = load(D.SALES).sparkSession.createDataFrame(
        [("B", 10.0, 2.0, "Web"), ("A", None, 5.0, "Web"), ("B", 1.5, None, None), ("A", 2.0, 1.0, "Tienda")],
        "producto string, precio double, cantidad double, canal string")
    report = kpi_report(sales)
    kpis = {r.kpi_id: r for r in report.kpis.collect()}
    assert kpis["kpi-revenue"].value == "23,50 €" and kpis["kpi-ticket"].numeric_value == 3.375
    assert kpis["kpi-topprod"].value == "A" and kpis["kpi-tx"].value == "4 pedidos"
    assert [tuple(r) for r in report.breakdown.collect()] == [("Web", 2, 50.0), ("Tienda", 1, 25.0)]


def test_general_kpis(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string")
    report = kpi_report(df)
    rows = {r.kpi_id: r for r in report.kpis.collect()}
    assert report.domain == "general" and report.breakdown is None
    assert rows["kpi-gen-rows"].value == "2" and rows["kpi-gen-cols"].subtitle == "1 numéricas, 1 categóricas"


def test_stream_replay(spark, tmp_path):
    spark.createDataFrame([(1, " ana sa ", "1,5"), (2, "LUIS", "N/D")], "i int, t string, n string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("i int, t string, n string").parquet(str(tmp_path / "in"))
    steps = [Step("trim_text", "t"), Step("normalize_case", "t"), Step("convert_numeric", "n")]
    query = replay_stream(stream, plan_to_json(steps)).writeStream.format("parquet").trigger(availableNow=True)
    query = query.option("checkpointLocation", str(tmp_path / "state")).start(str(tmp_path / "out"))
    assert query.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [
        (1, "Ana SA", 1.5), (2, "Luis", None)]
    for bad in (Step("remove_duplicates"), Step("fill_missing", "t", {"strategy": "mode"})):  # no watermark, not fitted
        with pytest.raises(ValueError, match="stream"):
            replay_stream(stream, [bad])


@pytest.mark.parametrize("buckets", [1, 3, 4096])
def test_first_values_of_ungrouped_cells_are_exact(spark, monkeypatch, buckets):
    """Also where values share buckets, one value fills the first rows, and some rows have no place in the order."""
    from tersa.operators import analysis

    monkeypatch.setattr(analysis, "SAMPLE_BUCKETS", buckets)
    rows = [(i, "same", f"v{i * 31 % 17}", i % 3 if i % 2 else None) for i in range(400)]
    rows += [(400 + i, f"late {i % 9}", " ", None) for i in range(100)] + [(None, "nowhere", "x", 7)]
    df = spark.createDataFrame(rows, "id long, a string, b string, c int").repartition(5)
    listed = lambda approx: sorted((r.column_name, r.sample_values) for r in profile(df, order_by="id", approx=approx).collect())
    assert listed(True) == listed(False)


def _events(spark, n):
    return spark.range(n).selectExpr(
        "id", "timestamp_seconds(1700000000 + id DIV 3) AS ts", "concat(' k', id % 50) AS k", "IF(id % 7 = 0, NULL, id % 50 * 1.25D) AS x",
        "IF(id % 5 = 0, NULL, concat('w', id % 50 % 3)) AS w", "IF(id % 11 = 0, NULL, CAST(id % 50 AS INT)) AS i",
    )


_STREAMED = [
    Step("trim_text", "k"), Step("fill_missing", "x", {"strategy": "median"}), Step("fill_missing", "w", {"strategy": "mode"}),
    Step("fill_missing", "i", {"strategy": "mode"}), Step("clamp_range", "x", {"min_value": 5, "max_value": 50}),
    Step("fill_missing", "x", {"strategy": "mean"}), Step("fill_missing", "nope", {"strategy": "mean"}, status="rejected"),
]


def test_a_fitted_plan_is_json_and_gives_the_same_table(spark):
    df = _events(spark, 400)
    fitted = fit_plan(df, _STREAMED)
    assert plan_from_json(plan_to_json(fitted)) == fitted
    plain, again = execute_plan(df, _STREAMED).frame, execute_plan(df, plan_from_json(plan_to_json(fitted))).frame
    assert plain.dtypes == again.dtypes and sorted(map(str, plain.collect())) == sorted(map(str, again.collect()))
    few = execute_plan(df.where("id % 7 = 0 AND id < 40"), fitted).frame.select("x").distinct().collect()
    whole = execute_plan(df, _STREAMED).frame.where("id % 7 = 0").select("x").distinct().collect()
    assert few == whole  # other rows are filled with what the plan was fitted with
    assert fit_plan(df, [Step("fill_missing", "ts", {"strategy": "median"})])[0].parameters == {"strategy": "median"}
    empty = fit_plan(df.where("false"), [Step("fill_missing", "x", {"strategy": "mean"})])
    assert execute_plan(df, empty).frame.where("x IS NULL").count() == df.where("x IS NULL").count()


def test_a_stream_in_batches_with_a_restart_gives_the_batch_answer(spark, tmp_path):
    df = _events(spark, 600)
    for i in range(6):
        df.where(f"id DIV 100 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    steps = fit_plan(df, _STREAMED) + [Step("remove_duplicates", parameters={"subset_columns": ["k"]}), Step("drop_column", "id")]
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def run(batches):
        writer = replay_stream(stream, plan_to_json(steps), ("ts", "1 hour")).writeStream.option("checkpointLocation", str(tmp_path / "state"))
        if batches is None:
            query = writer.trigger(availableNow=True).start(str(tmp_path / "out"))
            assert query.awaitTermination(240)
        else:
            query = writer.start(str(tmp_path / "out"))
            while len([p for p in query.recentProgress if p["numInputRows"]]) < batches and query.exception() is None:
                time.sleep(0.2)
            query.stop()

    run(2)
    run(None)
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = execute_plan(df, steps, order_by="id").frame
    columns = ["k", "w"]
    assert sorted(map(tuple, got.select(columns).collect())) != [] and got.count() == batch.count() == 50
    assert sorted(r.k for r in got.collect()) == sorted(r.k for r in batch.collect())
    assert got.columns == batch.columns and got.where("x IS NULL OR w IS NULL OR i IS NULL").count() == 0


def test_streams_refuse_what_needs_all_rows(spark, tmp_path):
    _events(spark, 5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(_events(spark, 1).schema).parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError, match="watermark"):
        replay_stream(stream, [Step("remove_duplicates")])
    with pytest.raises(ValueError, match="stream"):
        replay_stream(stream, [Step("fill_missing", "x", {"strategy": "mean"})], ("ts", "1 hour"))
    with pytest.raises(ValueError, match="event time"):
        replay_stream(stream, [Step("drop_column", "ts"), Step("remove_duplicates")], ("ts", "1 hour"))
    with pytest.raises(ValueError):
        replay_stream(stream, [Step("remove_duplicates", parameters={"subset_columns": ["nope"]})], ("ts", "1 hour"))


def test_results_do_not_depend_on_partitioning(load):
    df = load(D.ORDERS).withColumn("i", F.monotonically_increasing_id())
    df = df.sparkSession.createDataFrame(df.collect(), df.schema)
    seen = []
    for n in (1, 16):
        a = Analysis(df.repartition(n), order_by="i")
        seen.append((sorted(map(str, profile(a).collect())), sorted(map(str, quality_issues(a).collect())),
                     sorted(map(str, propose_plan(a).collect()))))
    assert seen[0] == seen[1]


def test_duplicates_of_wide_and_narrow_rows(spark):
    rows = [(1, "a", None), (1, "a", None), (1, None, "a"), (2, "a", "b")] * 2
    wide = spark.createDataFrame(rows, "x int, s string, t string")
    assert duplicate_rows(wide).first().duplicates_count == 5
    assert duplicate_rows(wide.select("x")).first().duplicates_count == 6
    assert duplicate_rows(wide.limit(0)).first().asDict() == {
        "row_count": 0, "duplicates_count": 0, "duplicates_percentage": 0.0}


def test_hot_value_is_one_row_per_task_in_the_value_table(spark):
    df = spark.range(9000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('v', id) END AS v")
    a = Analysis(df.repartition(4), order_by="id", materialize=False)
    plan = a.text_values._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_count") > plan.index("Exchange hashpartitioning")
    hot = a.text_values.where("text = 'hot'").collect()
    assert [(r.n, r.first) for r in hot] == [(3000, 0)]


def test_no_python_in_plans(spark, load):
    df = load(D.PEOPLE)
    a = Analysis(df)
    frames = [profile(a), quality_issues(a), propose_plan(a), execute_plan(df, propose_steps(a)).frame]
    for f in frames:
        plan = f._jdf.queryExecution().executedPlan().toString()
        assert "PythonUDF" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
        assert "CartesianProduct" not in plan


def test_approximate_profile(spark):
    df = spark.range(1000).selectExpr("id", "CAST(id % 7 AS STRING) AS d", "concat('t', id % 5) AS t")
    exact, approx = by_name(profile(df, order_by="id")), by_name(profile(df, order_by="id", approx=True))
    for name in exact:
        assert exact[name].inferred_type == approx[name].inferred_type
        assert approx[name].unique_count == pytest.approx(exact[name].unique_count, rel=0.1)
        assert approx[name].mean == exact[name].mean


def test_local_frame_is_a_local_relation(spark):
    df = local_frame(spark, [("a", 1)], "s string, n bigint")
    assert "LocalTableScan" in df._jdf.queryExecution().executedPlan().toString()


def test_large_dictionaries_are_audited_like_small_ones(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",), (None,), ("z",)] * 2, "v string").repartition(3)
    small = {"a": "A", "b": "b", "c": "C"}
    counted = []
    for extra in (61, 62, 500):
        mappings = small | {f"x{i}": "y" for i in range(extra)}
        done = execute_plan(df, [Step("normalize_category", "v", {"mappings": mappings}), Step("normalize_case", "v", {"mode": "lower"})])
        counted.append([(r.modified, r.rows) for r in done.audit.orderBy("position").collect()])
        assert sorted(map(str, (r.v for r in done.frame.collect()))) == sorted(map(str, ["a", "b", "c", None, "z"] * 2))
        assert done.frame.columns == ["v"]
    assert counted == [[(4, 10), (4, 10)]] * 3


def test_approximate_samples_come_from_all_rows(spark):
    rows = [(i, None if i < 60 else f"t{max(i - 200, 0) // 50}", i // 90) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, v string, n int").repartition(4)
    exact, approx = (by_name(profile(df, order_by="id", approx=a)) for a in (False, True))
    for name in ("id", "v", "n"):
        assert approx[name].sample_values == exact[name].sample_values
    assert len(exact["v"].sample_values) == 5 and approx["v"].estimated and not exact["v"].estimated


def test_approximate_mode_reads_few_values_once(spark, monkeypatch):
    monkeypatch.setattr(analysis_module, "COPIES", 7)
    monkeypatch.setattr(analysis_module, "FEW_VALUES", 20)
    rows = [(i, [None, " ", "1,5", "N/D", "7"][i % 5], f"t{i}", ["12", "3"][i % 40 == 0]) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, few string, many string, num string").repartition(3)
    a = Analysis(df, order_by="id", approx=True)
    assert a.grouped_columns == [1, 3]
    assert {r.position: (r["count"], r.n) for r in a.text_values.groupBy("position").agg(F.count("*").alias("count"), F.sum("n").alias("n")).collect()} == {
        1: (5, 400), 2: (400, 400), 3: (2, 400)
    }
    cells = a.sketch_cells().where("number IS NOT NULL").groupBy("position", "number").count().collect()
    assert {(r.position, r.number): r["count"] for r in cells if r.position} == {(1, 1.5): 80, (1, 7.0): 80, (3, 3.0): 10, (3, 12.0): 390}
    exact, approx = by_name(profile(df, order_by="id")), by_name(profile(a))
    for name in ("few", "many", "num"):
        for c in ("inferred_type", "null_count", "sample_values", "min_value", "max_value", "mean", "std"):
            assert approx[name][c] == exact[name][c]
    assert approx["num"].median == 12.0 and approx["few"].unique_count == 3
    long = spark.range(40).selectExpr("repeat(CAST(id % 2 AS STRING), 200) AS t")
    monkeypatch.setattr(analysis_module, "FEW_BYTES", 399)
    assert Analysis(long, approx=True).grouped_columns == []


def test_approximate_mode_counts_case_variants_exactly(spark):
    df = spark.range(3000).selectExpr("concat('WORD', id) AS v").repartition(3)
    assert [r.case_variants for r in Analysis(df, approx=True).case_variants().collect()] == [0]
    twice = df.union(df.selectExpr("lower(v) AS v"))
    assert [r.case_variants for r in Analysis(twice, approx=True).case_variants().collect()] == [3000]


def test_zero_signs_and_nested_values_in_duplicates(spark):
    df = spark.createDataFrame([(0.0, "a" * 60), (-0.0, "a" * 60), (1.0, "b")], "x double, t string")
    for frame in (df, df.select("x")):
        assert duplicate_rows(frame).first().duplicates_count == 1
        assert frame.count() - apply_operation(frame, "remove_duplicates").count() == 1
    nested = spark.createDataFrame([(("a, b", "c"), "t" * 60), (("a", "b, c"), "t" * 60)], "s struct<x:string,y:string>, t string")
    assert duplicate_rows(nested).first().duplicates_count == 0


def test_decimals_are_counted_by_their_digits(spark):
    df = spark.sql("SELECT explode(array(12345678901234567890, 12345678901234567891, 12345678901234567891)) AS d")
    row = by_name(profile(df))["d"]
    assert row.unique_count == 2 and set(row.sample_values) == {"12345678901234567890", "12345678901234567891"}


def test_steps_of_long_plans_keep_their_order(spark):
    rows = [(f"STEP-{i:03d}", "trim_text", f"c{i}", "{}", "", 0.9, "low", i, "proposed") for i in range(1, 1203)]
    schema = ("step_id string, operation string, column string, parameters string, reason string, "
              "confidence double, risk string, affected_rows_estimate bigint, status string")
    steps = collect_steps(spark.createDataFrame(rows, schema).repartition(5))
    assert [s.column for s in steps] == [f"c{i}" for i in range(1, 1203)]


def _nodes(df, name):
    """Nodes of the plan; of one that has run, of its final form (the printed text also has the first one)."""
    text = df._jdf.queryExecution().executedPlan().toString()
    final = re.findall(r"== Final Plan ==(.*?)== Initial Plan ==", text, re.S)
    return sum(part.count(name) for part in final) if final else text.count(name)


def test_statistics_after_a_dedup_read_the_source_a_fixed_number_of_times(spark, tmp_path):
    path = str(tmp_path / "wide")
    cells = [f"IF(id % {7 + i} = 0, NULL, CAST(id * {i + 1} % 101 AS DOUBLE)) AS c{i}" for i in range(6)]
    spark.range(500).selectExpr("id % 400 AS id").selectExpr("id", *cells).write.parquet(path)
    df = spark.read.parquet(path)
    scans = []
    for n in (1, 3, 6):
        steps = [Step("remove_duplicates")] + [Step("fill_missing", f"c{i}", {"strategy": "median"}) for i in range(n)]
        done = execute_plan(df, steps, order_by="id")
        scans.append(_nodes(done.frame, "FileScan"))
        rows = done.frame.collect()
        for i in range(n):
            known = sorted(r[f"c{i}"] for r in df.distinct().collect() if r[f"c{i}"] is not None)
            filled = sorted(r[f"c{i}"] for r in rows)
            assert len(filled) == len(rows) and statistics.median(known) in filled
    assert scans[0] == scans[1] == scans[2]


def test_mixed_statistics_share_a_barrier(spark):
    rows = [(1, 1.0, "b", 4), (2, None, "a", 4), (3, 5.0, None, None), (4, 3.0, "a", 7), (5, None, "b", 7)]
    df = spark.createDataFrame(rows, "id int, x double, t string, n int")
    steps = [
        Step("fill_missing", "x", {"strategy": "mean"}), Step("fill_missing", "missing", {"strategy": "mean"}),
        Step("fill_missing", "t", {"strategy": "mode"}), Step("fill_missing", "n", {"strategy": "mode"}),
        Step("fill_missing", "id", {"strategy": "median"}),
    ]
    done = execute_plan(df, steps)
    assert [tuple(r) for r in done.frame.orderBy("id").collect()] == [
        (1, 1.0, "b", 4), (2, 3.0, "a", 4), (3, 5.0, "a", 4), (4, 3.0, "a", 7), (5, 3.0, "b", 7)
    ]
    audit = {r.position: (r.status, r.modified) for r in done.audit.collect()}
    assert audit == {1: ("applied", 2), 2: ("error", None), 3: ("applied", 1), 4: ("applied", 1), 5: ("applied", 0)}


def test_an_audit_reads_each_segment_once(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(300).selectExpr("id % 200 AS id", "IF(id % 7 = 0, NULL, id % 10 * 1.0D) AS x", "concat(' t', id % 3) AS t").write.parquet(path)
    steps = [
        Step("trim_text", "t"), Step("remove_duplicates"), Step("fill_missing", "x", {"strategy": "mean"}),
        Step("normalize_case", "t", {"mode": "upper"}), Step("drop_column", "nope"),
    ]
    done = execute_plan(spark.read.parquet(path), steps, order_by="id")
    rows = {r.position: (r.status, r.rows, r.modified) for r in done.audit.collect()}
    before, after = 300, done.frame.count()
    gaps = spark.read.parquet(path).distinct().where("x IS NULL").count()
    assert rows == {
        1: ("applied", before, before), 2: ("applied", after, before - after), 3: ("applied", after, gaps),
        4: ("applied", after, after), 5: ("error", None, None),
    }
    # before the dedup, after it, and after the barrier, which also reads the table for its mean
    assert _nodes(done.audit, "FileScan") == 4


def _plans():
    big = {f" t{i}": f"T{i}" for i in range(2000)}
    return [
        ([Step("trim_text", "t"), Step("fill_missing", "x", {"strategy": "median"}), Step("convert_datetime", "d"),
          Step("normalize_case", "t", {"mode": "upper"}), Step("drop_column", "nope")], {"purge_empty_rows": True}),
        ([Step("trim_text", "t"), Step("remove_duplicates"), Step("fill_missing", "x", {"strategy": "mean"}),
          Step("normalize_case", "t", {"mode": "upper"})], {"purge_empty_rows": True}),
        ([Step("remove_duplicates"), Step("trim_text", "t"), Step("remove_duplicates")], {"checkpoint": True}),
        ([Step("normalize_category", "t", {"mappings": big}), Step("rename_column", "t", {"new_name": "u"}),
          Step("trim_text", "u"), Step("fill_missing", "x", {"strategy": "mean"}), Step("drop_column", "x")], {}),
        ([], {"purge_empty_rows": True}), ([], {}),
    ]


@pytest.mark.parametrize("number", range(6))
def test_a_write_counts_what_the_lazy_audit_counts(spark, tmp_path, number):
    source, out = str(tmp_path / "source"), str(tmp_path / "clean")
    spark.range(300).selectExpr(
        "IF(id > 280, NULL, id % 200) AS id", "IF(id % 7 = 0 OR id > 280, NULL, id % 10 * 1.0D) AS x",
        "IF(id > 280, ' ', concat(' t', id % 3)) AS t", "IF(id > 280, '', IF(id % 2 = 0, '2026-01-05', 'bad')) AS d",
    ).write.parquet(source)
    steps, options = _plans()[number]
    done = execute_plan(spark.read.parquet(source), steps, order_by="id", **options)
    watched = done.watched()
    watched.frame.write.parquet(out)
    audit = watched.audit()
    assert sorted(map(tuple, audit.collect())) == sorted(map(tuple, done.audit.collect()))
    assert sorted(map(str, spark.read.parquet(out).collect())) == sorted(map(str, done.frame.collect()))
    if number in (0, 3, 4):  # nothing to aggregate: the audit reads no table
        assert _nodes(audit, "FileScan") == 0


def test_write_and_audit_are_one_job_where_nothing_is_shuffled(spark, tmp_path):
    spark.range(200).selectExpr("id", "concat(' t', id % 3) AS t").write.parquet(str(tmp_path / "a"))
    watched = execute_plan(spark.read.parquet(str(tmp_path / "a")), [Step("trim_text", "t"), Step("drop_column", "id")]).watched()
    context = spark.sparkContext
    context.setJobGroup("watched", "")
    try:
        watched.frame.write.parquet(str(tmp_path / "b"))
        audit = [tuple(r)[5:7] for r in watched.audit().collect()]
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(audit) == [(200, 200), (200, 200)]
    assert len(context.statusTracker().getJobIdsForGroup("watched")) <= 2  # the write, and the local rows of the audit


def test_a_task_that_fails_once_does_not_count_twice(spark, tmp_path):
    """A writer that fails in each task's first attempt, after rows have been counted."""
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark import TaskContext
from pyspark.sql import SparkSession
from tersa import Step, execute_plan
spark = (SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.execution.arrow.maxRecordsPerBatch", "5").getOrCreate())
spark.sparkContext.setLogLevel("OFF")

def fail_once(batches):
    for i, batch in enumerate(batches):
        if i == 3 and TaskContext.get().attemptNumber() == 0:
            raise RuntimeError("lost")
        yield batch

df = spark.range(0, 100, 1, 4).selectExpr("id", "concat(' t', id % 3) AS t")
steps = [Step("trim_text", "t"), Step("normalize_case", "t", {{"mode": "upper"}})]
watched = execute_plan(df, steps).watched()
watched.frame.mapInArrow(fail_once, watched.frame.schema).write.parquet({str(tmp_path / "out")!r})
print("COUNTS", sorted((r.rows, r.modified) for r in watched.audit().collect()), spark.read.parquet({str(tmp_path / "out")!r}).count())
"""
    ran = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert "COUNTS [(100, 100), (100, 100)] 100" in ran.stdout, ran.stdout[-500:] + ran.stderr[-500:]


def test_audit_without_steps_is_empty(spark):
    done = execute_plan(spark.range(3).toDF("x"), [])
    assert done.audit.count() == 0 and "modified" in done.audit.columns


def test_checkpoints_keep_types_and_can_be_dropped(spark):
    import glob

    df = spark.sql("SELECT id, NULL AS nothing, CAST(id AS DECIMAL(20,2)) AS d, date'2026-01-05' AS day FROM range(5)")
    back = reliable_checkpoint(df)
    assert back.dtypes == df.dtypes and sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert drop_checkpoints(spark) >= 1
    assert not glob.glob(spark.conf.get("spark.checkpoint.dir") + "/tersa-" + "[0-9a-f]" * 16)


def test_quality_reads_a_written_value_table(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(500).selectExpr("id", "concat(' v', id % 40) AS a", "upper(concat('w', id % 30)) AS b").write.parquet(path)
    df = spark.read.parquet(path)
    kept, plain = (Analysis(df, order_by="id", materialize=m) for m in (True, False))
    rows = lambda a: sorted(map(str, quality_issues(a).collect()))
    assert rows(kept) == rows(plain)
    assert "partial_count" not in kept.text_values._jdf.queryExecution().executedPlan().toString()
