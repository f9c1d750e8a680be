"""Usage evidence: lines are read once, names are worked out once per package."""

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import usage as U

WANTED = "repository_id int, ecosystem string, package_name string"
LINES = "repository_id int, path string, line_no int, text string"


@pytest.fixture
def lines(spark, tmp_path):
    rows = [
        (1, "a/setup.py", 1, "import web_kit"), (1, "a/setup.py", 2, "setup(install_requires=['Web.Kit>=1'])"), (1, "m.py", 1, "from web_kit import x"),
        (1, "requirements.txt", 1, "web-kit==1"), (1, "Pipfile", 1, "[packages]"), (1, "Pipfile", 2, 'web_kit = "*"'),
        (1, "w/b.ts", 1, "import 'left/sub'"), (1, "package.json", 1, '"left": "1",'), (1, "notes.md", 1, "import web_kit"), (1, None, 1, "import web_kit"),
    ]
    spark.createDataFrame(rows, LINES).write.parquet(f"{tmp_path}/lines")
    return spark.read.parquet(f"{tmp_path}/lines")


def test_every_kind_of_file_is_matched_from_lines_stored_once(spark, lines):
    wanted = spark.createDataFrame([(1, "PyPI", "Web_Kit"), (1, "npm", "left"), (1, "npm", "web-kit"), (2, "PyPI", "Web_Kit"), (1, None, "left")], WANTED)
    refs = U.match_usage(lines, wanted)
    assert not set(refs.inputFiles()) & set(lines.inputFiles())
    got = sorted((r.path, r.line_no, r.ecosystem, r.package_name, r.kind) for r in refs.collect())
    kit, left = ("PyPI", "Web_Kit"), ("npm", "left")
    assert got == [
        ("Pipfile", 2, *kit, "config"), ("a/setup.py", 1, *kit, "import"), ("a/setup.py", 2, *kit, "config"), ("m.py", 1, *kit, "import"),
        ("package.json", 1, *left, "config"), ("requirements.txt", 1, *kit, "config"), ("w/b.ts", 1, *left, "import"),
    ]
    stored = U.by_reader(lines)
    assert stored.count() == 10 and U.by_reader(stored) is stored


def test_names_of_a_package_are_the_same_for_every_repository(spark):
    wanted = spark.createDataFrame([(1, "PyPI", "python-dateutil"), (2, "PyPI", "python-dateutil"), (2, "PyPI", "A.b"), (2, "PyPI", "A.b"), (2, "PyPI", "--"), (3, "npm", None), (3, None, "x")], WANTED)
    named = U.with_names(wanted)
    assert U.with_names(named) is named
    keys = ["repository_id", "ecosystem", "package_name"]
    each = U.import_name_candidates(wanted.distinct())
    rows = each.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("position", "import_name")))["import_name"].alias("searched")).collect()
    assert sorted(map(str, named.filter(F.size("searched") > 0).select(*keys, "searched").collect())) == sorted(map(str, rows))
    spelled = named.select(*keys, F.explode("spelled").alias("import_name"))
    assert sorted(map(str, spelled.collect())) == sorted(map(str, U.name_variants(each).select(*keys, "import_name").collect()))
    assert sorted(r.package_name or "" for r in named.collect()) == ["", "--", "A.b", "python-dateutil", "python-dateutil", "x"]
