import difflib
import random
import shutil
import subprocess

import pytest

from tidemark.operators.lifecycle import blamed
from tidemark.sources.history import blame, changed_files, changelog, churn, file_patches, read_log


def test_replay_equals_tracking_every_line(spark):
    """Random histories; the commit of each line is tracked beside the patches that are made of them."""
    r = random.Random(6)
    commits, files, truth = [], {f"dir/f{k}.txt": [] for k in range(5)}, {f"dir/f{k}.txt": [] for k in range(5)}
    for n in range(40):
        commit, parts = f"{n:040x}", []
        for name in r.sample(sorted(files), 2):
            old, new = files[name], list(files[name])
            for _ in range(r.randrange(1, 4)):
                at = r.randrange(len(new) + 1)
                new[at : at + r.randrange(3)] = [f"{r.randrange(30)}" for _ in range(r.randrange(4))]
            if old == new:
                continue
            marks = []
            for tag, i, j, a, b in difflib.SequenceMatcher(None, old, new).get_opcodes():
                marks += truth[name][i:j] if tag == "equal" else [commit] * (b - a)
            body = "\n".join(difflib.unified_diff(old, new, f"a/{name}", f"b/{name}", lineterm=""))
            parts.append(f"diff --git a/{name} b/{name}\n" + ("new file mode 100644\n" if not old and not any(name in c[4] for c in commits) else "") + body + "\n")
            files[name], truth[name] = new, marks
        commits.append((commit, f"author {n % 3}", "2024-01-01", f"fix: {n}", "".join(parts), n))
    df = spark.createDataFrame(commits, "commit string, author string, date string, summary string, patch string, seq long")
    got = {(x["file"], x["line"]): x["commit"] for x in blame(df).collect()}
    assert got == {(f, i): c for f, marks in truth.items() for i, c in enumerate(marks, 1)}
    log = changelog(df).collect()
    assert len(log) == 40 and {x["kind"] for x in log} == {"fix"} and sorted(x["nth"] for x in log) == list(range(1, 41))
    assert blame(df.limit(0)).count() == 0
    findings = spark.createDataFrame([("dir/f0.txt", 1, "x"), ("gone", 1, "y")], "file string, line int, type string")
    assert {x["file"]: x["commit"] for x in blamed(findings, blame(df)).collect()} == {"dir/f0.txt": truth["dir/f0.txt"][0] if truth["dir/f0.txt"] else None, "gone": None}


@pytest.mark.skipif(not shutil.which("git"), reason="needs git to make a history")
def test_a_real_log_with_renames_deletions_and_missing_newlines(spark, tmp_path):
    repo = tmp_path / "repo"
    repo.mkdir()

    def git(*args):
        return subprocess.run(["git", "-c", "user.name=A B", "-c", "user.email=a@b", *args], cwd=repo, check=True, capture_output=True, text=True).stdout

    def commit(message, **texts):
        for name, text in texts.items():
            (repo / f"{name}.txt").write_text(text)
        git("add", "-A")
        git("commit", "-qm", message)

    git("init", "-q")
    commit("feat: one", a="1\n2\n3\n4\n5\n6\n7\n8\n", b="x\ny\n")
    commit("fix(core): two", a="0\n1\n2\n3\n4\n5\n6\n8\nend", b="x\n")
    git("mv", "a.txt", "c d.txt")
    commit("move")
    (repo / "c d.txt").write_text("0\n1\nnew\n3\n4\n5\n6\n8\nend\nmore\n")
    git("rm", "-q", "b.txt")
    commit("drop b")
    commit("again", b="y\nx\n", a="other\n")
    (tmp_path / "log.txt").write_text(git("log", "-p", "--reverse", "--first-parent", "-M", "--date=short", "--format=%x1e%H%x1f%an%x1f%ad%x1f%s%x1f"))
    commits = read_log(spark, str(tmp_path / "log.txt"))
    assert [x["summary"] for x in commits.orderBy("seq").collect()] == ["feat: one", "fix(core): two", "move", "drop b", "again"]
    got = {(x["file"], x["line"]): (x["commit"], x["author"]) for x in blame(commits).collect()}
    want = {}
    for name in ("a.txt", "b.txt", "c d.txt"):
        rows = [x for x in git("blame", "--porcelain", name).split("\n") if len(x.split(" ")[0]) == 40]
        want |= {(name, int(x.split(" ")[2])): (x.split(" ")[0], "A B") for x in rows}
    assert got == want
    first = commits.where("summary = 'move'").first()["commit"]
    assert {(x["file"], x["state"], x["commits"]) for x in changed_files(commits, first).collect()} == {("c d.txt", "modified", 1), ("b.txt", "added", 2), ("a.txt", "added", 1)}
    assert {x["file"]: (x["commits"], x["added"], x["removed"]) for x in churn(commits).collect()}["b.txt"] == (4, 4, 2)
    assert file_patches(commits).where("state = 'renamed'").count() == 1
