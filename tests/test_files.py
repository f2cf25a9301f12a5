"""Tree entries, path filters and contents."""

import base64

import pytest

from modcensus.operators import files
from modcensus.operators.extract import module_calls
from modcensus.plans.scan import scan_files, scan_module_calls
from modcensus.schemas import FILE_CONTENTS, REPOSITORIES, TREE_ENTRIES


HOSTS = {"hub": "https://github.com", "lab": "https://gitlab.com", "other": "https://other"}


def repositories(spark):
    rows = [
        (provider, HOSTS[name], i, "o", name, f"o/{name}", branch, False, False, f"https://gl/o/{name}", "c")
        for i, (provider, name, branch) in enumerate([("github", "hub", "main"), ("gitlab", "lab", "dev")])
    ]
    return spark.createDataFrame(rows, REPOSITORIES)


def tree(spark, rows):
    full = [(HOSTS[repo], f"o/{repo}", path, kind, sha, 1, i) for i, (repo, path, kind, sha) in enumerate(rows)]
    return spark.createDataFrame(full, TREE_ENTRIES)


def paths_of(frame):
    return sorted(r.path for r in frame.collect())


def paths(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "path STRING")


def test_skipped_directories(spark):
    kept = ["main.tf", "a/b.tf", "build", "a/dist", "a/.hidden.tf", "builds/x.tf", "_x/y.tf"]
    gone = [f"{d}/x.tf" for d in [
        "node_modules", ".git", ".terraform", ".terragrunt-cache", "dist", "build", "target", ".vscode", ".idea",
        "__pycache__", ".DS_Store", ".any", "a/.any", "a/build/b"]]
    assert paths_of(files.outside_skipped_directories(paths(spark, *kept, *gone))) == sorted(kept)


@pytest.mark.parametrize(
    "types, local, expected",
    [
        (["terraform"], False, ["a.tf"]),
        (["terraform", "terragrunt"], False, ["a.tf", "b.hcl"]),
        ([], False, []),
        (None, False, ["a.tf", "b.hcl", "c.md"]),
        ([], True, ["a.tf", "b.hcl"]),
        (None, True, ["a.tf", "b.hcl"]),
        (["terragrunt"], True, ["b.hcl"]),
    ],
)
def test_file_types(spark, types, local, expected):
    assert paths_of(files.keep_file_types(paths(spark, "a.tf", "b.hcl", "c.md"), types, local)) == expected


@pytest.mark.parametrize(
    "include, exclude, expected",
    [
        (None, None, ["a/x.tf", "b/x.tf", "b/y.tf"]),
        (["^b/"], None, ["b/x.tf", "b/y.tf"]),
        (["x", "y"], ["^a"], ["b/x.tf", "b/y.tf"]),
        (["x"], ["x"], []),
        ([], None, []),
        (None, [], ["a/x.tf", "b/x.tf", "b/y.tf"]),
    ],
)
def test_path_patterns(spark, include, exclude, expected):
    assert paths_of(files.match_paths(paths(spark, "a/x.tf", "b/x.tf", "b/y.tf"), include, exclude)) == expected


ENTRIES = [
    ("hub", "a.tf", "blob", "1"),
    ("hub", "no-sha.tf", "blob", None),
    ("hub", "dir.tf", "tree", "2"),
    ("hub", "README.md", "blob", "3"),
    ("lab", "no-sha.tf", "blob", None),
    ("lab", "x/terragrunt.hcl", "blob", "4"),
    ("lab", "", "blob", "5"),
    ("other", "a.tf", "blob", "6"),
]


def test_candidate_files(spark):
    rows = files.candidate_files(tree(spark, ENTRIES), repositories(spark))
    got = sorted((r.repository, r.path, r.file_type, r.url, r.sha) for r in rows.collect())
    assert got == [
        ("o/hub", "a.tf", "terraform", "https://github.com/o/hub/blob/main/a.tf", "1"),
        ("o/lab", "no-sha.tf", "terraform", "https://gl/o/lab/-/blob/dev/no-sha.tf", None),
        ("o/lab", "x/terragrunt.hcl", "terragrunt", "https://gl/o/lab/-/blob/dev/x/terragrunt.hcl", "4"),
    ]
    limited = files.candidate_files(tree(spark, ENTRIES), repositories(spark), max_files=1)
    assert sorted((r.repository, r.path) for r in limited.collect()) == [("o/hub", "a.tf"), ("o/lab", "no-sha.tf")]
    only = files.candidate_files(tree(spark, ENTRIES), repositories(spark), file_types=["terragrunt"])
    assert paths_of(only) == ["x/terragrunt.hcl"]
    assert paths_of(files.candidate_files(tree(spark, ENTRIES), repositories(spark), file_types=[])) == []


def b64(data):
    return base64.b64encode(data if isinstance(data, bytes) else data.encode()).decode()


LONG = 'module "a" {\n  source = "ä/b/c"\n}\n' * 30
CONTENTS = [  # name, encoding, content, text on GitHub, text on GitLab; an Exception stands for an error
    ("plain", "base64", b64("hé"), "hé", "hé"),
    ("lines", "base64", "\n".join(b64(LONG)[i : i + 60] for i in range(0, len(b64(LONG)), 60)) + "\n", LONG, LONG),
    ("empty", "base64", "", "", ""),
    ("none", "base64", None, OSError, OSError),
    ("text", "text", "a = 1", OSError, "a = 1"),
    ("no-encoding", None, "a = 1", OSError, "a = 1"),
    ("bad-bytes", "base64", b64(b"a\xff\xfeb"), "a��b", "a��b"),
    ("unpadded", "base64", b64("hell").rstrip("="), "hell", "hell"),
    ("url-safe", "base64", base64.urlsafe_b64encode(b"??>>~~").decode(), "??>>~~", "??>>~~"),
    ("junk", "base64", "aGV\x01s*bG8=", "hello", "hello"),
]


def test_contents_and_errors(spark):
    entries = [(repo, f"{name}.tf", "blob", "1") for name, *_ in CONTENTS for repo in ("hub", "lab")]
    entries.append(("hub", "gone.tf", "blob", "1"))
    landed = [(HOSTS[repo], f"o/{repo}", f"{name}.tf", enc, text) for name, enc, text, *_ in CONTENTS for repo in ("hub", "lab")]
    contents = spark.createDataFrame(landed, FILE_CONTENTS)
    attached = scan_files(repositories(spark), tree(spark, entries), contents)
    good = {(r.repository, r.path): r.content for r in files.fetched_files(attached).collect()}
    bad = {(r.repository, r.path): r.error for r in files.fetch_errors(attached).collect()}
    for name, _, _, on_hub, on_lab in CONTENTS:
        for repo, text in (("o/hub", on_hub), ("o/lab", on_lab)):
            key = (repo, f"{name}.tf")
            if text is OSError:
                maker = "GitHub" if repo == "o/hub" else "GitLab"
                assert bad.pop(key) == f"Unexpected response format from {maker} API"
            else:
                assert good.pop(key) == text, key
    assert bad == {("o/hub", "gone.tf"): files.NO_CONTENT} and good == {}
    counts = {r.repository: (r.success_count, r.error_count) for r in files.fetch_counts(attached).collect()}
    assert counts == {"o/hub": (7, 4), "o/lab": (9, 1)}
    outcomes = files.attach_outcomes(files.candidate_files(tree(spark, entries), repositories(spark)), contents)
    columns = ["host", "repository", "path", "provider", "error"]
    flags = sorted(map(str, outcomes.select(*columns).collect()))
    assert flags == sorted(map(str, attached.select(*columns).collect()))


def test_equal_names_keep_their_files(spark):
    """One repository name on two hosts: entries and contents stay on theirs."""
    listed = spark.createDataFrame(
        [("github", "https://github.com", 0, "acme", "x", "acme/x", "main", False, False, "u", "c"),
         ("gitlab", "https://gitlab.com", 1, "acme", "x", "acme/x", "main", False, False, "u", "c")], REPOSITORIES)
    entries = spark.createDataFrame([("https://gitlab.com", "acme/x", "a.tf", "blob", "1", 1, 0)], TREE_ENTRIES)
    contents = spark.createDataFrame([(h, "acme/x", "a.tf", "text", "a = 1") for h in HOSTS.values()], FILE_CONTENTS)
    attached = scan_files(listed, entries, contents).collect()
    assert [(r.host, r.content, r.error) for r in attached] == [("https://gitlab.com", "a = 1", None)]
    outcomes = files.repository_outcomes(listed, files.landed_trees(entries), scan_files(listed, entries, contents))
    got = {r.host: (r.status, r.error, r.success_count, r.error_count) for r in outcomes.collect()}
    assert got == {"https://gitlab.com": ("success", None, 1, 0), "https://github.com": ("error", files.NO_TREE, 0, 0)}
    bare = spark.createDataFrame([("https://github.com", "acme/x", "README.md", "blob", "1", 1, 0)], TREE_ENTRIES)
    outcomes = files.repository_outcomes(listed, files.landed_trees(bare), scan_files(listed, bare, contents))
    assert {r.host: r.status for r in outcomes.collect()} == {"https://github.com": "success", "https://gitlab.com": "error"}
    assert files.scan_totals(outcomes).first().asDict() == {"repository_successes": 1, "repository_errors": 1, "file_successes": 0, "file_errors": 0}


def test_early_extraction_gives_the_same_calls(spark):
    block = 'module "a" {\n source = "x?ref=1"\n}\n'
    entries = [(repo, f"{i}.tf", "blob", "1" if i % 3 else None) for i in range(12) for repo in ("hub", "lab")]
    landed = [
        (HOSTS[repo], f"o/{repo}", f"{i}.tf", "text" if i % 2 else "base64", block * i if i % 2 else b64(block * i))
        for i in range(11) for repo in ("hub", "lab", "other")
    ]
    inputs = (repositories(spark), tree(spark, entries), spark.createDataFrame(landed, FILE_CONTENTS))
    wanted = module_calls(files.fetched_files(scan_files(*inputs)))
    got = scan_module_calls(*inputs)
    assert got.columns == wanted.columns
    rows = sorted(map(str, got.collect()))
    assert rows == sorted(map(str, wanted.collect())) and len(rows) > 20


def test_repository_file_counts(spark):
    rows = spark.createDataFrame(
        [("r1", "terraform"), ("r1", "terragrunt"), ("r2", "terraform")], "repository STRING, file_type STRING"
    )
    got = {r.repository: (r.overall, r.files, r.terraform_files, r.terragrunt_files)
           for r in files.repository_file_counts(rows).collect()}
    assert got == {"r1": (False, 2, 1, 1), "r2": (False, 1, 1, 0), None: (True, 3, 2, 1)}


def test_file_counts_of_one_name_on_two_hosts(spark):
    rows = spark.createDataFrame(
        [("h1", "r", "terraform"), ("h2", "r", "terragrunt"), ("h2", "r", "terraform"), (None, "r", "terraform")], "host STRING, repository STRING, file_type STRING"
    )
    got = {(r.host, r.overall): (r.files, r.terraform_files, r.terragrunt_files) for r in files.repository_file_counts(rows).collect()}
    assert got == {("h1", False): (1, 1, 0), ("h2", False): (2, 1, 1), (None, False): (1, 1, 0), (None, True): (4, 3, 1)}


def test_an_empty_landed_tree_is_a_success(spark):
    listed = spark.createDataFrame(
        [("gitlab", "https://gitlab.com", i, "o", name, f"o/{name}", "main", False, False, "u", "c") for i, name in enumerate(("full", "empty", "missing"))], REPOSITORIES)
    entries = spark.createDataFrame([("https://gitlab.com", "o/full", f"{i}.tf", "blob", "1", 1, i) for i in range(2)], TREE_ENTRIES)
    contents = spark.createDataFrame([("https://gitlab.com", "o/full", "0.tf", "text", "a")], FILE_CONTENTS)
    trees = spark.createDataFrame([("https://gitlab.com", f"o/{name}") for name in ("full", "empty", "empty")], "host STRING, full_name STRING")
    attached = files.attach_outcomes(files.candidate_files(entries, listed), contents)
    outcomes = files.repository_outcomes(listed, trees, attached)
    got = {r.repository: (r.status, r.success_count, r.error_count) for r in outcomes.collect()}
    assert got == {"o/full": ("success", 1, 1), "o/empty": ("success", 0, 0), "o/missing": ("error", 0, 0)}
    errors = sorted((r.kind, r.repository, r.path, r.error) for r in files.scan_errors(outcomes, attached).collect())
    assert errors == [("file", "o/full", "1.tf", files.NO_CONTENT), ("repository", "o/missing", None, files.NO_TREE)]
