"""Table functions give the rows of the DataFrame operators."""

from collections import Counter

from inkprint.functions import pysyntax, tables


def test_lateral_rows_equal_the_operators(spark, programs):
    tables.register(spark)
    programs.createOrReplaceTempView("programs")
    nodes = spark.sql("SELECT id, n.* FROM programs, LATERAL ast_nodes(code) AS n")
    expected = pysyntax.ast_node_table(programs)
    assert nodes.columns == expected.columns
    assert Counter(map(tuple, nodes.collect())) == Counter(map(tuple, expected.collect()))
    found = spark.sql("SELECT id AS source_file, f.position, f.code FROM programs, LATERAL extract_functions(code) AS f")
    table = pysyntax.function_table(programs.withColumnsRenamed({"id": "path", "code": "source"}))
    assert Counter(map(tuple, found.collect())) == Counter(map(tuple, table.collect()))


def test_nulls_give_no_rows(spark):
    tables.register(spark)
    for name in ("ast_nodes", "extract_functions"):
        assert spark.sql(f"SELECT * FROM {name}(CAST(NULL AS STRING))").count() == 0
