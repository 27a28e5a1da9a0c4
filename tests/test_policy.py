import pytest

from helpers import rows
from labelloom.operators.policy import write_audit

EVENT = "shard_root string, tool_name string, file_path string, path string, notebook_path string"


def decide(make, path, tool="Write", shard=".shard-a", deny=(), root="/repo", normalize=False, field="file_path"):
    values = {"file_path": None, "path": None, "notebook_path": None, field: path}
    df = make(EVENT, (shard, tool, values["file_path"], values["path"], values["notebook_path"]))
    return rows(write_audit(df, root, deny, normalize=normalize), "allowed", "reason")[0]


@pytest.mark.parametrize("path,want", [
    (".shard-a/state/verdicts.jsonl", (True, "inside current shard")),
    (".shard-a", (True, "inside current shard")),
    ("/repo/.shard-a/loop.log", (True, "inside current shard")),
    ("./.shard-a//state/./x", (True, "inside current shard")),
    ("/tmp/scratch.txt", (True, "tmp path")),
    ("/var/folders/x", (True, "tmp path")),
    ("/tmpx/scratch.txt", (False, "default deny")),
    (".baseline/state/verdicts.jsonl", (False, "baseline deny")),
    ("/repo/.baseline/x", (False, "baseline deny")),
    (".shard-b/state/verdicts.jsonl", (False, "cross-shard deny")),
    (".shard-ab/x", (False, "cross-shard deny")),
    (".shard-a/scripts/something.py", (False, "code deny")),
    (".shard-a/__pycache__/x.py", (True, "inside current shard")),
    (".shard-a/__pycache__/x.pyc", (True, "inside current shard")),
    ("src/x.py", (False, "code deny")),
    ("foo/bar.txt", (False, "default deny")),
    ("/etc/passwd", (False, "default deny")),
])
def test_paths(make, path, want):
    assert decide(make, path) == want


def test_events_that_are_not_judged(make):
    assert decide(make, "anywhere.py", shard=None) == (True, "no shard")
    assert decide(make, "anywhere.py", shard="") == (True, "no shard")
    assert decide(make, ".baseline/x", tool="Read") == (True, "not a write tool")
    assert decide(make, None) == (True, "no path")
    assert decide(make, "") == (True, "no path")


@pytest.mark.parametrize("field", ["file_path", "path", "notebook_path"])
@pytest.mark.parametrize("tool", ["Write", "Edit", "MultiEdit", "NotebookEdit"])
def test_every_tool_and_path_key(make, field, tool):
    assert decide(make, ".baseline/x", tool=tool, field=field) == (False, "baseline deny")


def test_project_prefixes_come_before_the_shard_rules(make):
    assert decide(make, "results/out.jsonl", deny=["results/", "docs/"]) == (False, "project red-line deny")
    assert decide(make, ".shard-a/secret/x", deny=[".shard-a/secret"]) == (False, "project red-line deny")


def test_absolute_shard_root(make):
    assert decide(make, ".shard-a/x", shard="/repo/.shard-a") == (True, "inside current shard")
    assert decide(make, "work/.shard-a/x", shard="work/.shard-a") == (True, "inside current shard")


def test_dot_dot_is_resolved_on_request(make):
    path = ".shard-a/../.baseline/x"
    assert decide(make, path) == (True, "inside current shard")
    assert decide(make, path, normalize=True) == (False, "baseline deny")
    assert decide(make, "../../x", normalize=True) == (False, "default deny")
    assert decide(make, "/../tmp/x", normalize=True) == (True, "tmp path")
