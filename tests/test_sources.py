"""Real repositories, made with git, exported with the script and read back."""

import os
import subprocess

import pytest
from helpers import ROOT, rows
from pyspark.sql import functions as F

from annalist import schemas as T
from annalist.operators import commits as extract
from annalist.operators import revision, tags
from annalist.operators.identity import resolve_identities
from annalist.plans.load import history_from_exports, store_history, stored_history
from annalist.sources import exports, tables


class Repository:
    def __init__(self, path):
        self.path = str(path)
        os.makedirs(self.path)
        self.time = 1_600_000_000
        self.git("init", "-q", "-b", "main")

    def git(self, *args, name="Jack Dau", email="jack@dau.org"):
        self.time += 100
        env = dict(
            os.environ,
            GIT_AUTHOR_NAME=name,
            GIT_AUTHOR_EMAIL=email,
            GIT_COMMITTER_NAME=name,
            GIT_COMMITTER_EMAIL=email,
            GIT_AUTHOR_DATE=f"{self.time} +0130",
            GIT_COMMITTER_DATE=f"{self.time + 7} +0000",
            GIT_CONFIG_GLOBAL="/dev/null",
            GIT_CONFIG_NOSYSTEM="1",
        )
        done = subprocess.run(["git", "-C", self.path, *args], env=env, check=True, capture_output=True, text=True)
        return done.stdout.strip()

    def write(self, file, content):
        os.makedirs(os.path.dirname(os.path.join(self.path, file)), exist_ok=True)
        with open(os.path.join(self.path, file), "wb") as out:
            out.write(content if isinstance(content, bytes) else content.encode())

    def commit(self, message, name="Jack Dau", email="jack@dau.org"):
        self.git("add", "-A")
        self.git("commit", "-q", "-m", message, name=name, email=email)
        return self.git("rev-parse", "HEAD")


@pytest.fixture(scope="module")
def exported(tmp_path_factory):
    base = tmp_path_factory.mktemp("git")
    repo = Repository(base / "work")
    repo.write("jacks file.txt", "one\ntwo\n")
    repo.write("dir/data.bin", bytes(range(256)))
    ids = {"first": repo.commit("first")}
    repo.git("tag", "light")
    repo.git("checkout", "-q", "-b", "side")
    repo.write("jacks file.txt", "one\ntwo\nthree\nfour\nfive\n")
    repo.write("johns.txt", "x\n")
    ids["side"] = repo.commit("side", "John Doe", "john@doe.com")
    repo.git("checkout", "-q", "main")
    repo.write("main.txt", "m\n")
    ids["main"] = repo.commit("main")
    repo.git("merge", "-q", "--no-ff", "-m", "merge", "side")
    ids["merge"] = repo.git("rev-parse", "HEAD")
    repo.git("tag", "-a", "v1", "-m", "release", name="Release Master", email="r@m.org")
    repo.git("mv", "main.txt", 'od"d.txt')
    repo.write(".mailmap", "# names\nJohn Snow <john@doe.com>\n")
    ids["last"] = repo.commit("move")
    out = base / "exports"
    script = os.path.join(ROOT, "tools", "export_history.sh")
    subprocess.run(["sh", script, repo.path, str(out / "demo")], check=True)
    return str(out), ids


@pytest.fixture(scope="module")
def loaded(spark, exported, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store") / "history")
    stored = store_history(history_from_exports(spark, exported[0]), path)
    again = stored_history(spark, path)
    assert again.blame is None and again.commits.count() == stored.commits.count()
    return stored


def test_commit_log(spark, exported):
    root, ids = exported
    log = exports.read_commit_log(spark, f"{root}/*/log.txt")
    assert rows(log.commits, "repo_id")[0] == ("demo",)
    first = log.commits.filter(F.col("commit_id") == ids["first"]).first()
    assert (first["author_tz_offset"], first["committer_timestamp"] - first["author_timestamp"]) == (90, 7)
    assert log.commits.orderBy("walk_pos").first()["commit_id"] == ids["last"]
    assert sorted(rows(log.parents.filter(F.col("commit_id") == ids["merge"]), "parent_id", "ordinal")) == sorted(
        [(ids["main"], 0), (ids["side"], 1)]
    )
    assert log.parents.filter(F.col("commit_id") == ids["first"]).count() == 0
    moved = rows(log.file_changes.filter(F.col("commit_id") == ids["last"]), "path", "change")
    assert sorted(moved) == [(".mailmap", 1), ("main.txt", -1), ('od"d.txt', 1)]
    binary = log.commit_files.filter("path = 'dir/data.bin'").first()
    assert binary["insertions"] is None


def test_histories(exported, loaded):
    _, ids = exported
    history = loaded
    lines = {r["commit_id"]: (r["insertions"], r["deletions"]) for r in history.commits.collect()}
    assert len(lines) == 5 and history.commits.filter("is_merge_commit").count() == 1
    assert lines[ids["first"]] == (2, 0) and lines[ids["side"]] == (4, 0) and lines[ids["merge"]] == (0, 0)
    assert set(rows(history.commits, "author_name")) == {("Jack Dau",), ("John Snow",)}
    assert ("john@doe.com",) in rows(history.commits, "author_email")
    linear = {r["commit_id"]: (r["files_count"], r["insertions"]) for r in history.linear_history.collect()}
    assert linear == {
        ids["first"]: (2, 2),
        ids["main"]: (3, 1),
        ids["merge"]: (4, 4),
        ids["last"]: (5, 3),
    }


def test_blame_and_files(loaded):
    assert sorted(rows(revision.contribution(loaded.blame))) == [("Jack Dau", 5), ("John Snow", 4)]
    listed = {r["file"]: (r["is_binary"], r["size_bytes"], r["lines_count"]) for r in loaded.files.collect()}
    assert listed["dir/data.bin"] == (True, 256, 0)
    assert listed["jacks file.txt"] == (False, 24, 5) and listed['od"d.txt'] == (False, 2, 1)


def test_tag_runs(loaded):
    found = rows(tags.tag_summary(loaded.assigned_tags), "tag", "commits_count", "tagger_name")
    assert found == [("unreleased", 1, None), ("v1", 3, "Release Master"), ("light", 1, None)]


def test_mailmap_forms(spark, tmp_path):
    file = tmp_path / "r" / "mailmap.txt"
    file.parent.mkdir()
    file.write_text(
        "# comment\n\nProper One <one@x>\n<new@x> <two@x>\nProper Three <p3@x> <three@x>\n"
        "Proper Four <p4@x> Old Four <four@x>  # why\nLater One <ONE@x>\n"
    )
    rules = exports.read_mailmap(spark, str(file))
    assert rows(rules.orderBy("rule_order").drop("rule_order", "repo_id")) == [
        ("Proper One", None, None, "one@x"),
        (None, "new@x", None, "two@x"),
        ("Proper Three", "p3@x", None, "three@x"),
        ("Proper Four", "p4@x", "Old Four", "four@x"),
        ("Later One", None, None, "ONE@x"),
    ]
    people = [("a", "One@X"), ("b", "two@x"), ("c", "three@x"), ("old four", "four@x"), ("other", "four@x")]
    people += [("", "two@x"), ("e", ""), (None, None), ("", "one@x")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(people)], "i int, author_name string, author_email string")
    mapped = resolve_identities(df, rules).orderBy("i")
    assert rows(mapped, "author_name", "author_email") == [
        ("Later One", "One@X"),
        ("b", "two@x"),
        ("Proper Three", "three@x"),
        ("Proper Four", "four@x"),
        ("other", "four@x"),
        ("Empty Empty", "two@x"),
        ("e", "empty@empty.empty"),
        ("Empty Empty", "empty@empty.empty"),
        ("Later One", "one@x"),
    ]


def test_a_rule_joins_two_people_and_keeps_both_addresses(spark):
    rule = spark.createDataFrame([("r", "John Doe", "john@doe.com", "Author Author", "author@author.net", 0)], T.MAILMAP)
    people = spark.createDataFrame(
        [("r", "John Doe", "john@doe.com"), ("r", "Author Author", "author@author.net")],
        "repo_id string, author_name string, author_email string",
    )
    mapped = sorted(rows(resolve_identities(people, rule, by=["repo_id"])))
    assert mapped == [("r", "John Doe", "author@author.net"), ("r", "John Doe", "john@doe.com")]


def test_shares_change_no_name(spark):
    """Repeated rows, names and addresses that are NULL, and a table without commits."""
    rules = spark.createDataFrame(
        [("r", "One", None, None, "a@x", 0), ("r", "Two", None, "b", "a@x", 1), ("r", None, "n@x", None, "", 2)], T.MAILMAP
    )
    people = [("r", n, e) for n in ("b", "B", "", None, "c") for e in ("a@x", "A@X", "", None, "z@x")] * 3
    df = spark.createDataFrame(people, "repo_id string, author_name string, author_email string")

    def name(n, e):
        if e in ("a@x", "A@X"):
            return "Two" if n in ("b", "B") else "One"
        return n or "Empty Empty"

    # the rule of the empty address names a new one, so a person with a name keeps the empty one
    address = {None: "empty@empty.empty"}
    expected = sorted(
        ("r", name(n, e), "empty@empty.empty" if e == "" and not n else address.get(e, e)) for _, n, e in people
    )
    for salts in (1, 5):
        assert sorted(rows(resolve_identities(df, rules, by=["repo_id"], salts=salts))) == expected
    assert resolve_identities(df.limit(0), rules, by=["repo_id"]).count() == 0
    other = df.withColumn("repo_id", F.lit("s"))
    both = resolve_identities(df.unionByName(other), rules, by=["repo_id"])
    assert sorted(rows(both.filter("repo_id = 'r'"))) == expected
    assert both.filter("repo_id = 's' and author_name in ('One', 'Two')").count() == 0


def test_committers_without_address_are_credited_to_the_author(spark):
    commit = ("r", "c", 0, "A", "a@x", 10, 0, "C", "", 20)
    commits = spark.createDataFrame([commit, ("r", "d", 1, "A", "a@x", 10, 0, "C", "c@x", 20)], T.RAW_COMMITS)
    lines = spark.createDataFrame([("r", "HEAD", "f", "c", 3), ("r", "HEAD", "f", "d", 4)], T.BLAME_LINES)
    assert sorted(rows(extract.blame(lines, commits))) == [("f", "A", 10, 3), ("f", "C", 20, 4)]


@pytest.mark.parametrize("format", ["parquet", "json", "orc"])
def test_tables_are_read_with_their_declared_schema(spark, tmp_path, format):
    data = spark.createDataFrame([("r", "HEAD", "a.b", False, 1, 2), ("r", "old", "c", True, 3, 4)], T.FILES)
    data.write.format(format).save(str(tmp_path / "files"))
    read = tables.read_table(spark, "files", str(tmp_path / "files"), format)
    assert [f.dataType for f in read.schema] == [f.dataType for f in T.FILES]
    assert rows(tables.of_revision(read), "file") == [("a.b",)]
