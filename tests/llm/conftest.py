import os

import pytest

SF = "/root/testdata/sf0.001"

#: Rows that operators on documents must stand: nulls everywhere, empty and blank texts,
#: repeated rows, one long text, NUL and letters beyond ASCII.
HARD = [
    (None, None, None, None, None),
    (None, "no id here", "en", None, 10),
    (900001, "", "en", "s", 0),
    (900002, " \n\t ", None, "s", 4),
    (900003, "same words twice", "en", "s", 16),
    (900003, "same words twice", "en", "s", 16),
    (900004, "same words twice", "xx", "t", 16),
    (900005, "Nul\x00 and ünïcödé   ÀÉ 漢字 👍 " * 3, "en", "s", 90),
    (900006, ("one two three four five six seven eight nine ten eleven\n" * 3000), "en", "s", 9),
    (900007, "a", "en", "s", 1),
]
DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))


@pytest.fixture(scope="session")
def docs(spark, shared_folder):
    hard = spark.createDataFrame(HARD, DOCUMENT)
    if not os.path.isdir(SF):
        return hard
    return spark.read.parquet(f"{SF}/documents.parquet").unionByName(hard)


@pytest.fixture(scope="session")
def no_docs(spark, shared_folder):
    return spark.createDataFrame([], DOCUMENT)
