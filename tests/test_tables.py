"""Table functions against the table operators."""

import pytest

from quillspark import model
from quillspark.functions import tables
from quillspark.operators import chunking, citations

FILES = [
    ("a.ts", "export function f(a: number): string {\n  return 'x';\n}\nexport class C { m() { return 1; } }\n"),
    ("b.py", "def main():\n" + "    call(1)\n" * 40 + "\nclass Foo:\n" + "    x = 'a long enough value'\n" * 6),
    ("docs/c.MD", "# t\n\n" + "words and words\n" * 300),
    ("d", ""),
    ("e.go", None),
    (None, "text"),
]


@pytest.fixture(scope="module")
def files(spark):
    tables.register(spark)
    return spark.createDataFrame(FILES, "file_path string, source string")


def test_chunks_are_those_of_the_operator(spark, files):
    names = ["place", *(f.split(" ")[0] for f in model.CHUNK_FIELDS.split(", "))]
    got = spark.sql("SELECT c.* FROM {f} f, LATERAL chunks(f.file_path, f.source) c", f=files)
    want = chunking.explode_chunks(chunking.chunk_files(files.filter("file_path is not null"))).select(*names)
    assert got.columns == names
    key = lambda r: (r[1], r[0])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key) != []


def test_windows_and_citations(spark, files):
    got = spark.sql("SELECT f.file_path, w.* FROM {f} f, LATERAL windows(f.source, 50) w", f=files.filter("file_path is not null and source is not null"))
    want = chunking.line_windows(files.filter("file_path is not null and source is not null"), "file_path", "source", 50)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    answers = spark.createDataFrame([(1, "see a/b.ts:3-9, x.py:4 and a/b.ts:3-9; z.md:99999999999-3"), (2, None), (3, "none")], "id int, answer string")
    got = spark.sql("SELECT a.id, c.* FROM {a} a, LATERAL citations(a.answer) c", a=answers)
    want = citations.parse(answers, "id", "answer")
    assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))
    assert spark.sql("SELECT * FROM windows(NULL, 3)").count() == 0


def test_wrong_arguments_are_named(spark, files):
    with pytest.raises(Exception, match="expected .string, int."):
        spark.sql("SELECT * FROM windows('a', 'b')").collect()
