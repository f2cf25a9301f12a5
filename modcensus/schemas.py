"""Table schemas (DDL strings, usable with ``spark.read.schema``).

A repository is known by (``host``, ``full_name``); a host is written ``https://name[:port]``. Calls and
files carry the full name alone, as reports do: they show and count by it.
"""

REPOSITORIES = (
    "provider STRING, host STRING, list_pos BIGINT, owner STRING, name STRING, full_name STRING, default_branch STRING, "
    "archived BOOLEAN, private BOOLEAN, url STRING, clone_url STRING"
)

GITHUB_REPOSITORY = (
    "name STRING, full_name STRING, default_branch STRING, archived BOOLEAN, private BOOLEAN, "
    "html_url STRING, clone_url STRING, owner STRUCT<login: STRING, path: STRING, name: STRING>"
)

GITLAB_PROJECT = (
    "id BIGINT, name STRING, path STRING, path_with_namespace STRING, default_branch STRING, archived BOOLEAN, "
    "visibility STRING, web_url STRING, http_url_to_repo STRING, namespace STRUCT<name: STRING, path: STRING>"
)

TREE_ENTRIES = (
    "host STRING, full_name STRING, path STRING, entry_type STRING, sha STRING, size BIGINT, tree_pos BIGINT"
)

FILE_CONTENTS = "host STRING, full_name STRING, path STRING, encoding STRING, content STRING"

IAC_FILES = (
    "file_type STRING, repository STRING, path STRING, content STRING, url STRING, sha STRING, size BIGINT"
)

MODULE_CALLS = (
    "name STRING, source STRING, source_type STRING, version STRING, repository STRING, file_path STRING, "
    "file_url STRING, line_number INT, type STRING, block_pos INT"
)

FETCH_LOG = (
    "platform STRING, operation STRING, full_name STRING, path STRING, attempt INT, status INT, code STRING, "
    "message STRING, body_message STRING"
)
