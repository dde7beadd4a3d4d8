"""Scans, ingest hygiene, fingerprint, writing."""

import pytest
from pyspark.sql import functions as F

import fixtures_data as D
from tersa import (
    count_empty_rows, dataset_metadata, drop_empty_rows, fingerprint, scan_csv, scan_parquet,
    apply_operation, profile, validate_ingest, write_clean,
)
from tersa.sources.files import sniff_delimiter


@pytest.fixture
def csv_file(tmp_path):
    def make(content, name="t.csv"):
        path = tmp_path / name
        path.write_text(content, encoding="utf-8")
        return str(path)

    return make


def test_delimiters():
    for sep in ",;\t|":
        assert sniff_delimiter("\n".join(sep.join(["ab", "cd", "ef"]) for _ in range(5))) == sep
    assert sniff_delimiter("single column") == ","


def test_scan_types_tokens_and_padding(spark, csv_file):
    path = csv_file("a,b,c,d\n1,x,N/A,1.5\n2,N/D,--,2\n3,y\n4,z,w,3,overlong\n5,\"q,r\",null, 4 \n")
    df = scan_csv(spark, path)
    assert dict(df.dtypes) == {"a": "bigint", "b": "string", "c": "string", "d": "double"}
    assert [tuple(r) for r in df.orderBy("a").collect()] == [
        (1, "x", None, 1.5), (2, "N/D", "--", 2.0), (3, "y", None, None), (5, "q,r", None, 4.0),
    ]
    # Reading fewer columns must not bring overlong records back.
    assert df.select("a").count() == 4


def test_header_names(spark, csv_file):
    assert scan_csv(spark, csv_file("a,a,,b\n1,2,3,x\n")).columns == ["a", "a.1", "Unnamed: 2", "b"]


def test_empty_rows(spark, csv_file):
    df = scan_csv(spark, csv_file(D.SALES))
    assert df.count() == 8 and drop_empty_rows(df).count() == 7
    assert count_empty_rows(df).first().asDict() == {"rows_read": 8, "rows_purged": 1, "rows_kept": 7}
    odd = spark.createDataFrame([(" undefined ", None), ("NULL", ""), ("null", "nan")], "a string, b string")
    assert [r.a for r in drop_empty_rows(odd).collect()] == ["NULL"]


def test_validation_and_metadata(spark, csv_file):
    df = scan_csv(spark, csv_file("ID,Nombre,Importe\n1,Ana,10\n2,Luis,20\n"))
    assert validate_ingest(df).collect() == []
    meta = dataset_metadata(df, "x").first()
    assert (meta.row_count, meta.column_count, meta.columns, meta.warnings) == (2, 3, ["ID", "Nombre", "Importe"], [])
    assert [r.code for r in validate_ingest(df.limit(0)).collect()] == ["NO_ROWS_FOUND"]
    codes = {r.code for r in validate_ingest(df, max_rows=1, max_columns=2).collect()}
    assert codes == {"MANY_ROWS", "MANY_COLUMNS"}


def test_fingerprint(spark):
    df = spark.range(1000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN NULL ELSE 'x' END AS a", "NULL AS b")
    one = fingerprint(df).first()
    assert one == fingerprint(df.repartition(7)).first()
    assert one.hash_sum != fingerprint(df.where("id > 0")).first().hash_sum
    left = spark.createDataFrame([("a", None)], "a string, b string")
    right = spark.createDataFrame([(None, "a")], "a string, b string")
    assert fingerprint(left).first().hash_xor != fingerprint(right).first().hash_xor


def test_write_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b', 1.5), (2, None, None)], "i int, s string, x double")
    for kind in ("parquet", "csv"):
        write_clean(df, str(tmp_path / kind), kind)
    assert scan_parquet(spark, str(tmp_path / "parquet")).exceptAll(df).count() == 0
    back = scan_csv(spark, str(tmp_path / "csv"), sep=",", columns=["i", "s", "x"])
    assert {r.s for r in back.collect()} == {'a "q", b', None}
    with pytest.raises(ValueError):
        write_clean(df, str(tmp_path / "x"), "xlsx")


def test_many_part_files_share_one_header(spark, tmp_path):
    df = spark.range(20).select(F.col("id").alias("k"), F.lit("v").alias("t")).repartition(4)
    write_clean(df, str(tmp_path / "parts"), "csv")
    assert scan_csv(spark, str(tmp_path / "parts")).agg(F.sum("k")).first()[0] == 190


def test_long_whole_numbers_keep_their_digits(spark, csv_file):
    path = csv_file("id,code,mixed\n1234567890123456789,12345678901234567890,1.5\n1234567890123456790,2,3\n-1,3,4\n")
    df = scan_csv(spark, path)
    assert dict(df.dtypes) == {"id": "bigint", "code": "string", "mixed": "double"}
    assert df.select("id").distinct().count() == 3
    assert {r.code for r in df.collect()} == {"12345678901234567890", "2", "3"}


def test_blank_lines_above_the_header(spark, csv_file):
    df = scan_csv(spark, csv_file("\n  \na,b\n1,x\n2,y\n"), sep=",")
    assert df.columns == ["a", "b"] and [tuple(r) for r in df.orderBy("a").collect()] == [(1, "x"), (2, "y")]


def test_long_quoted_fields_in_malformed_rows(spark, csv_file):
    long = "x" * 100_000 + '""' * 1000
    path = csv_file(f'a,b\n1,"{long}",3\n2,"{long}"\n3,y\n')
    assert [r.a for r in scan_csv(spark, path, sep=",").orderBy("a").collect()] == [2, 3]


def _first_rows(df):
    kept = apply_operation(df, "remove_duplicates", subset_columns=["k"])
    samples = {r.column_name: r.sample_values for r in profile(df).collect()}
    return sorted(map(tuple, kept.collect())), samples


def test_first_rows_do_not_depend_on_splits(spark, tmp_path):
    """One file and many, read whole and in small splits: the same rows and values come first, without a column of order."""
    rows = [(f"k{i * 7919 % 40}", f"v{i * 104729 % 5000}", i) for i in range(5000)]
    df = spark.createDataFrame(rows, "k string, v string, i long").coalesce(1)
    first = {}
    for k, v, i in rows:
        first.setdefault(k, (k, v, i))
    seen = []
    for name, files in (("one", 1), ("many", 50)):
        path = str(tmp_path / name)
        df.repartitionByRange(files, "i").sortWithinPartitions("i").write.option("parquet.block.size", 16_384).parquet(path)
        for split in ("128m", "20k", "2k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            spark.conf.set("spark.sql.files.openCostInBytes", "1k")
            try:
                kept, samples = _first_rows(spark.read.parquet(path))
            finally:
                spark.conf.unset("spark.sql.files.maxPartitionBytes")
                spark.conf.unset("spark.sql.files.openCostInBytes")
            assert kept == sorted(first.values())
            seen.append((name, samples))
    assert len({str(s) for n, s in seen if n == "one"}) == 1 == len({str(s) for n, s in seen if n == "many"})
    assert seen[0][1]["v"] == [v for _, v, _ in rows[:5]]


def test_first_rows_of_csv_files_do_not_depend_on_splits(spark, tmp_path):
    rows = [(f"k{i * 7919 % 40}", f"v{i}") for i in range(5000)]
    path = str(tmp_path / "t.csv")
    with open(path, "w") as out:
        out.write("k,v\n" + "".join(f"{k},{v}\n" for k, v in rows))
    first = {}
    for k, v in rows:
        first.setdefault(k, (k, v))
    for split in ("128m", "5k", "1k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            df = spark.read.option("header", True).csv(path)
            assert sorted(map(tuple, apply_operation(df, "remove_duplicates", subset_columns=["k"]).collect())) == sorted(first.values())
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")


def test_tables_without_files_have_the_order_of_the_scan(spark):
    df = spark.range(10).selectExpr("id % 3 AS k", "id", "1 AS _metadata")
    assert apply_operation(df, "remove_duplicates", subset_columns=["k"]).count() == 3
    assert apply_operation(df.unionByName(df), "remove_duplicates", subset_columns=["k"]).count() == 3


def test_fingerprint_values(spark):
    """Each row's 64 bits, chained over values and null flags, computed by another implementation."""
    import xxhash

    def row_hash(i, t):
        h = 42
        for v, raw in ((i, None if i is None else i.to_bytes(8, "little", signed=True)), (t, None if t is None else t.encode())):
            h = h if raw is None else xxhash.xxh64(raw, seed=h).intdigest()
            h = xxhash.xxh64(int(v is None).to_bytes(4, "little"), seed=h).intdigest()
        return h - (1 << 64) if h >> 63 else h

    rows = [(1, "a"), (-7, None), (None, "é漢"), (None, None), (1, "a"), (2**62, "")]
    got = fingerprint(spark.createDataFrame(rows, "i bigint, t string")).first()
    hashes, xor = [row_hash(*r) for r in rows], 0
    for h in hashes:
        xor ^= h
    assert (got.row_count, got.hash_xor, got.hash_sum) == (6, xor, str(sum(hashes)))
