"""The corpus and its calls as DuckDB common table expressions."""

from checks import rules
from modcensus.fixed import SPACE

SEEDS = f"""seeds AS (
  SELECT o_orderkey AS o, o_custkey AS c, o_orderkey * 8 AS pos, {rules.ORDER_PATH} AS path,
    {rules.ORDER_IS_TERRAGRUNT} AS tg, {rules.ORDER_BLOCKS} AS blocks, {rules.ORDER_START} AS head,
    '' AS glue, '' AS tail
  FROM orders
  UNION ALL
  SELECT doc_id, doc_id, 1000000000000 + doc_id * 8, {rules.DOCUMENT_PATH}, {rules.DOCUMENT_IS_TERRAGRUNT},
    {rules.DOCUMENT_BLOCKS}, text || {rules.NL}, text || {rules.NL}, text
  FROM documents)"""

FILES = f"""{SEEDS},
files AS (
  SELECT o, c, pos AS tree_pos, {rules.REPO_FULL_NAME} AS repository, path,
    CASE WHEN tg THEN 'terragrunt' ELSE 'terraform' END AS file_type, {rules.FILE_URL} AS url, h, twin,
    head || array_to_string(list_transform(generate_series(1, blocks), lambda k: {rules.GLUED_BLOCK}), '') || tail AS content
  FROM (SELECT *, {rules.OWN_HOST} AS h, {rules.TWIN_HOST} AS twin FROM seeds))"""


def _trim(text: str) -> str:
    return f"regexp_replace({text}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def source_type_sql(s: str) -> str:
    return f"""CASE
    WHEN regexp_matches({s}, '^(\\./|\\.\\./|/)') THEN 'local'
    WHEN contains({s}, 'jfrog.io') AND NOT regexp_matches({s}, '\\.(tar\\.gz|zip)$') THEN 'artifactory'
    WHEN regexp_matches({s}, '\\.(tar\\.gz|zip)$') THEN 'archive'
    WHEN regexp_matches({s}, '^[^/]+/[^/]+/[^/]+|terraform-aws-modules|\\.terraform\\.io') THEN 'registry'
    WHEN regexp_matches({s}, 'git::|github\\.com|gitlab\\.com') THEN 'git'
    ELSE 'unknown' END"""


def query_version_sql(s: str) -> str:
    return (
        f"coalesce(nullif(regexp_extract({s}, '[?&]version=([^&]+)', 1), ''), "
        f"nullif(regexp_extract({s}, '[?&]ref=([^&]+)', 1), ''))"
    )


def normalize_sql(s: str) -> str:
    """Each rewrite on its own; without 'g' only the first match is replaced."""
    for p in ("ref", "version"):
        s = f"regexp_replace({s}, '\\?{p}=[^&]*&', '?')"
        s = f"regexp_replace({s}, '\\?{p}=[^&]*$', '')"
        s = f"regexp_replace({s}, '&{p}=[^&]*', '', 'g')"
    return f"regexp_replace({s}, '[?&]+$', '')"


def terragrunt_name_sql(path: str, source: str) -> str:
    bare = f"string_split({source}, '?')[1]"
    after = f"regexp_extract({bare}, '^(?s:.*)//((?s:.*))$', 1)"
    before = f"regexp_extract({bare}, '^((?s:.*))//(?s:.*)$', 1)"
    inner = f"list_filter(string_split({after}, '/'), lambda part: {_trim('part')} <> '')"
    cut = lambda t: f"regexp_replace({t}, '\\.(git|tar\\.gz|zip)$', '')"
    return f"""coalesce(
      nullif(regexp_extract({path}, '([^/]+)/terragrunt\\.hcl$', 1), ''),
      CASE WHEN contains({bare}, '//') THEN
        CASE WHEN len({inner}) > 0 THEN {cut(f"{inner}[-1]")}
        ELSE coalesce(nullif({cut(f"string_split({before}, '/')[-1]")}, ''), 'unknown') END
      WHEN {_trim(f"string_split({bare}, '/')[-1]")} = '' THEN 'unknown'
      ELSE coalesce(nullif({cut(f"string_split({bare}, '/')[-1]")}, ''), 'unknown') END)"""


_TF = f'module{SPACE}+"([^"]+)"{SPACE}+\\{{([\\s\\S]*?)\\}}'
_TG = f"terraform{SPACE}*\\{{([\\s\\S]*?)\\}}"
_SOURCE = f'source{SPACE}*={SPACE}*"([^"]+)"'
_VERSION = f'version{SPACE}*={SPACE}*"([^"]+)"'

# blocks with their running number; the line is counted over everything before the block
CALLS = f"""{FILES},
cut AS (
  SELECT file_type, repository, path, url,
    CASE WHEN file_type = 'terraform' THEN regexp_extract_all(content, '{_TF}', 0)
      ELSE regexp_extract_all(content, '{_TG}', 0) END AS found,
    CASE WHEN file_type = 'terraform' THEN string_split_regex(content, '{_TF}')
      ELSE string_split_regex(content, '{_TG}') END AS gaps
  FROM files),
numbered AS (
  SELECT *, unnest(found) AS block, unnest(generate_series(1, len(found))) AS i FROM cut),
opened AS (
  SELECT file_type, repository, path, url, i, block,
    array_to_string(gaps[1:i], '') || array_to_string(found[1:i - 1], '') AS before,
    CASE WHEN file_type = 'terraform' THEN regexp_extract(block, '{_TF}', 2)
      ELSE regexp_extract(block, '{_TG}', 1) END AS body
  FROM numbered),
sourced AS (
  SELECT *, CASE WHEN file_type = 'terraform' THEN regexp_extract(body, '{_SOURCE}', 1)
    ELSE {_trim(f"regexp_extract(body, '{_SOURCE}', 1)")} END AS source
  FROM opened),
calls AS (
  SELECT
    CASE WHEN file_type = 'terraform' THEN regexp_extract(block, '{_TF}', 1)
      ELSE {terragrunt_name_sql("path", "source")} END AS name,
    source, {source_type_sql("source")} AS source_type,
    CASE WHEN file_type = 'terraform'
      THEN coalesce(nullif(regexp_extract(body, '{_VERSION}', 1), ''), {query_version_sql("source")})
      ELSE {query_version_sql("source")} END AS version,
    repository, path AS file_path, url AS file_url,
    CAST(1 + length(before) - length(replace(before, chr(10), '')) AS INTEGER) AS line_number,
    file_type AS type, CAST(i - 1 AS INTEGER) AS block_pos
  FROM sourced WHERE source <> '')"""
