"""Scan target texts."""

import pytest

from modcensus.operators.targets import described_targets, scan_targets

SUPPORTED = "Supported platforms: github, gh, gitlab, gl, bitbucket, bb, local, file, fs"

ACCEPTED = {
    "github:acme": ("github", "acme", None, None),
    "GitHub:acme": ("github", "acme", None, None),
    "gh:acme/net": ("github", "acme", "net", None),
    "gl:grp/sub/net": ("gitlab", "grp", "sub/net", None),
    "gitlab:grp": ("gitlab", "grp", None, None),
    "bb:team/x": ("bitbucket", "team", "x", None),
    "bitbucket:team": ("bitbucket", "team", None, None),
    "github:a.b-c_d/e.f": ("github", "a.b-c_d", "e.f", None),
    "github:acme/": ("github", "acme", "", None),
    "local:/srv/iac": ("local", "/srv/iac", None, None),
    "local:/srv/../x//y/": ("local", "/x/y/", None, None),
    "local:./iac": ("local", "/base/dir/iac", None, None),
    "local:../iac/": ("local", "/base/iac", None, None),
    "file:iac": ("local", "/base/dir/iac", None, None),
    "fs:/": ("local", "/", None, None),
    "gitlab://gitlab.acme.io/grp/net": ("gitlab-self-hosted", "grp", "net", "https://gitlab.acme.io"),
    "gitlab://gitlab.com/grp": ("gitlab", "grp", None, "https://gitlab.com"),
    "GH://ghe.acme.io:8443/acme/a/b/": ("github-self-hosted", "acme", "a/b", "https://ghe.acme.io:8443"),
    "github://github.com/acme?x=1#y": ("github", "acme", None, "https://github.com"),
    "github://me:pw@github.com/acme": ("github", "acme", None, "https://github.com"),
    "gitlab://h:0080/grp": ("gitlab-self-hosted", "grp", None, "https://h:80"),
    "gl://h/a/./b/../c": ("gitlab-self-hosted", "a", "c", "https://h"),
    "gl://h/my grp/é": ("gitlab-self-hosted", "my%20grp", "%C3%A9", "https://h"),
    "local://share/x/y": ("local", "x", "y", "https://share"),
    "file:///srv/x": ("local", "srv", "x", "https://"),
    " github://github.com/acme ": ("github", "acme", None, "https://github.com"),
    "bb://bitbucket.org/team": ("bitbucket", "team", None, "https://bitbucket.org"),
}

REJECTED = {
    "": "Source must be a non-empty string",
    None: "Source must be a non-empty string",
    "github-acme": 'Invalid source format: "github-acme". Expected format: platform:identifier '
    "(e.g., github:myorg, local:/path/to/dir)",
    "GitHub:": 'Missing identifier after "github:"',
    "SVN:acme": f'Unsupported platform: "svn". {SUPPORTED}',
    "github:/x": 'Invalid github identifier: "/x". Expected format: org[/repo]',
    "github:my@org": 'Invalid github identifier: "my@org". Must contain only alphanumeric characters, dots, hyphens, '
    "and underscores.",
    "gl:grp/my@x": 'Invalid gitlab repository: "my@x". Must contain only alphanumeric characters, dots, hyphens, '
    "underscores, and slashes.",
    "svn://h/x": f'Invalid URL format: "svn://h/x". Unsupported platform: "svn". {SUPPORTED}',
    "gitlab://h/": 'Invalid URL format: "gitlab://h/". Invalid URL: missing group/organization in path',
    "gitlab://h": 'Invalid URL format: "gitlab://h". Invalid URL: missing group/organization in path',
    "gitlab://h:x/a": 'Invalid URL format: "gitlab://h:x/a". Invalid URL',
    "gitlab://h:70000/a": 'Invalid URL format: "gitlab://h:70000/a". Invalid URL',
    "gitlab://a b/c": 'Invalid URL format: "gitlab://a b/c". Invalid URL',
    "://h/a": 'Invalid URL format: "://h/a". Invalid URL',
}


@pytest.fixture(scope="module")
def parsed(spark):
    texts = [(t,) for t in [*ACCEPTED, *REJECTED]]
    frame = scan_targets(spark.createDataFrame(texts, "original_input STRING"), base_dir="/base/dir")
    return {r.original_input: r for r in frame.collect()}


@pytest.mark.parametrize("text", list(ACCEPTED))
def test_accepted(parsed, text):
    r = parsed[text]
    assert (r.platform, r.identifier, r.repository, r.host, r.error) == (*ACCEPTED[text], None)


@pytest.mark.parametrize("text", list(REJECTED))
def test_rejected(parsed, text):
    r = parsed[text]
    assert (r.platform, r.identifier, r.repository, r.host, r.error) == (None, None, None, None, REJECTED[text])


def test_described(spark):
    texts = spark.createDataFrame([("gl:grp/net",), ("bb:team",), ("local:/srv/iac",), ("x",)], "original_input STRING")
    rows = {r.original_input: r for r in described_targets(scan_targets(texts)).collect()}
    r = rows["gl:grp/net"]
    assert (r.platform_name, r.supported, r.target, r.scope) == ("GitLab", True, "grp/net", "Single repository: net")
    r = rows["bb:team"]
    assert (r.platform_name, r.supported, r.target, r.scope) == ("Bitbucket", False, "team", "All repositories in team")
    assert rows["local:/srv/iac"].scope == "Local directory: iac"
    r = rows["x"]
    assert (r.platform_name, r.supported, r.target, r.scope) == (None, None, None, None)
