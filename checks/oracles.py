"""SQL counterparts of the catalog's queries, for DuckDB.

They share the derivation of the corpus with the catalog (``rules``) and nothing else.
"""

from checks import rules
from checks.oracle_parts import (
    CALLS,
    FILES,
    normalize_sql,
    source_type_sql,
    terragrunt_name_sql,
)

IN_ORDER = """source COLLATE en_us, version COLLATE en_us NULLS LAST, repository COLLATE en_us,
    file_path COLLATE en_us, line_number, block_pos"""

def percent_sql(n: str, total: str) -> str:
    """One decimal of the double n / total * 100, in whole numbers.

    Times 2 ** 53 a double of at least 1 is a whole number, so its exact value is rounded half up.
    """
    share = f"(CAST({n} AS DOUBLE) / {total} * 100)"
    scaled = f"CAST({share} * 9007199254740992 AS HUGEINT)"
    tenths = f"((20 * {scaled} + 9007199254740992) // (2 * 9007199254740992))"
    return f"CAST({tenths} // 10 AS VARCHAR) || '.' || CAST({tenths} % 10 AS VARCHAR)"


REPOS = f"""listed AS (
  SELECT c_custkey AS c, unnest(CASE WHEN c_custkey % 13 = 0 THEN [0::BIGINT, {rules.AGAIN}] ELSE [0::BIGINT] END) AS again FROM customer),
hosted AS (
  SELECT c, again, {rules.OWN_HOST} AS h FROM listed
  UNION ALL SELECT c, again + {rules.TWIN_PAGES}, {rules.TWIN_HOST} FROM listed WHERE {rules.TWIN_HOST} IS NOT NULL),
repos AS (
  SELECT c, h, {rules.REPO_PROVIDER} AS provider, {rules.REPO_HOST} AS host, (c + again) * 100 AS list_pos, {rules.REPO_NAMESPACE} AS owner,
    {rules.REPO_NAME} AS name, {rules.REPO_FULL_NAME} AS full_name, coalesce({rules.REPO_BRANCH}, 'main') AS default_branch,
    {rules.REPO_ARCHIVED} AS archived, {rules.REPO_VISIBILITY} <> 'public' AS private,
    {rules.REPO_URL} AS url, {rules.REPO_URL} || '.git' AS clone_url
  FROM hosted),
firsts AS (
  SELECT * FROM repos QUALIFY row_number() OVER (PARTITION BY host, full_name ORDER BY list_pos) = 1),
kept AS (SELECT * FROM firsts WHERE NOT archived)"""

FILE_TYPE = """CASE
    WHEN regexp_matches(path, '\\.(tf|tfvars)$') OR regexp_matches(path, '(^|/)\\.terraform\\.lock\\.hcl$') THEN 'terraform'
    WHEN regexp_matches(path, '\\.hcl$') AND NOT regexp_matches(path, '\\.terraform\\.lock[^/]*$') THEN 'terragrunt' END"""

_TREE = f"""landed AS (
  SELECT *, {rules.REPO_HOST} AS host FROM (
    SELECT o, c, h, false AS is_twin, repository, path, tree_pos, content FROM files
    UNION ALL SELECT o, c, twin, true, repository, path, tree_pos, content FROM files WHERE twin IS NOT NULL AND {rules.TWIN_HAS})
  WHERE {rules.HAS_TREE}),
tree AS (
  SELECT host, is_twin, repository AS full_name, c, o, path, 'blob' AS entry_type, tree_pos FROM landed
  {" ".join(
      f"UNION ALL SELECT host, is_twin, repository, c, o, {path}, '{kind}', tree_pos + {i + 1} FROM landed WHERE {condition}"
      for i, (condition, path, kind) in enumerate(rules.EXTRAS)
  )})"""
TREE = f"{FILES}, {_TREE}"

_CANDIDATES = f"""{_TREE}, {REPOS},
candidates AS (
  SELECT {FILE_TYPE} AS file_type, t.host, t.is_twin, t.full_name AS repository, t.path, t.o,
    CASE WHEN r.provider = 'github' THEN 'https://github.com/' || t.full_name || '/blob/' || r.default_branch || '/' || t.path
      ELSE r.url || '/-/blob/' || r.default_branch || '/' || t.path END AS url,
    CASE WHEN {rules.HAS_SHA} THEN md5(t.path) END AS sha, r.provider, t.tree_pos
  FROM tree t JOIN kept r ON t.full_name = r.full_name AND t.host = r.host
  WHERE t.entry_type = 'blob' AND {FILE_TYPE} IS NOT NULL
    AND (r.provider <> 'github' OR {rules.HAS_SHA}))"""
CANDIDATES = f"{FILES}, {_CANDIDATES}"

# what a fetch gives: GitHub takes base64 only, GitLab also plain text
_ATTACHED = f"""{_CANDIDATES},
attached AS (
  SELECT k.*, f.content,
    CASE WHEN f.path IS NULL OR NOT {rules.IS_LANDED.replace("o %", "k.o %")}
        OR (k.is_twin AND NOT {rules.TWIN_IS_LANDED.replace("o %", "k.o %")}) THEN 'No content was landed for this file'
      WHEN {rules.IS_EMPTY_RESPONSE.replace("o %", "k.o %")} OR ({rules.IS_PLAIN.replace("o %", "k.o %")} AND k.provider = 'github')
      THEN 'Unexpected response format from ' || CASE k.provider WHEN 'github' THEN 'GitHub' ELSE 'GitLab' END || ' API'
    END AS error
  FROM candidates k LEFT JOIN files f ON k.repository = f.repository AND k.path = f.path)"""
ATTACHED = f"{FILES}, {_ATTACHED}"
OUTCOMES = f"""{ATTACHED},
outcomes AS (
  SELECT k.host, k.full_name AS repository, any_value(k.provider) AS provider,
    CASE WHEN any_value(t.host) IS NULL THEN 'error' ELSE 'success' END AS status,
    CASE WHEN any_value(t.host) IS NULL THEN 'No file tree was landed for this repository' END AS error,
    count(*) FILTER (a.path IS NOT NULL AND a.error IS NULL) AS success_count, count(*) FILTER (a.error IS NOT NULL) AS error_count
  FROM kept k LEFT JOIN (SELECT DISTINCT host, full_name FROM repos WHERE {rules.TREE_LANDED}) t ON k.host = t.host AND k.full_name = t.full_name
    LEFT JOIN attached a ON a.host = k.host AND a.repository = k.full_name
  GROUP BY k.host, k.full_name)"""

USAGE = f"""{CALLS},
usage AS (SELECT type, source, version, count(*) AS n FROM calls GROUP BY ALL)"""

RAW = f"""{USAGE},
summary AS (
  SELECT type, source, 'total' AS entry, NULL AS version, sum(n)::BIGINT AS n FROM usage GROUP BY type, source
  UNION ALL
  SELECT type, source, 'version', version, n FROM usage WHERE version IS NOT NULL)"""

MERGED = f"""{RAW},
merged AS (
  SELECT source, entry, version, n FROM summary WHERE type = 'terragrunt'
  UNION ALL
  SELECT source, entry, version, n FROM summary WHERE type = 'terraform'
    AND source NOT IN (SELECT source FROM calls WHERE type = 'terragrunt'))"""

NORMALIZED = f"""{CALLS},
placed AS (
  SELECT *, {normalize_sql("source")} AS module, row_number() OVER (ORDER BY {IN_ORDER}) AS place FROM calls),
normalized AS (
  SELECT module, arg_min(source_type, place) AS source_type, bool_or(version IS NOT NULL) AS versioned,
    'total' AS entry, NULL AS version, count(*) AS n FROM placed GROUP BY module
  UNION ALL
  SELECT module, NULL, NULL, 'version', version, count(*) FROM placed WHERE version IS NOT NULL GROUP BY module, version)"""

_SHARES = f"""first_seen AS (
  SELECT source_type, row_number() OVER (ORDER BY {IN_ORDER}) AS place FROM calls),
kinds AS (
  SELECT source_type, count(*) AS n, min(place) AS place, sum(count(*)) OVER () AS total
  FROM first_seen GROUP BY source_type),
source_kinds AS (
  SELECT row_number() OVER (ORDER BY n DESC, place) AS rank, source_type, n, {percent_sql("n", "total::BIGINT")} AS percent
  FROM kinds),
file_kinds AS (
  SELECT k.rank, k.type, count(calls.type) AS n
  FROM (VALUES (1, 'terraform'), (2, 'terragrunt')) k(rank, type) LEFT JOIN calls ON calls.type = k.type
  GROUP BY k.rank, k.type)"""
SHARES = f"{CALLS}, {_SHARES}"

COUNTERS = """(SELECT count(*) FROM calls) AS module_count, (SELECT count(*) FROM files) AS file_count,
  (SELECT count(*) FROM calls WHERE type = 'terraform') AS terraform_module_count,
  (SELECT count(*) FROM calls WHERE type = 'terragrunt') AS terragrunt_module_count,
  (SELECT count(*) FROM files WHERE file_type = 'terraform') AS terraform_file_count,
  (SELECT count(*) FROM files WHERE file_type = 'terragrunt') AS terragrunt_file_count"""

NAME_PATTERN = "regexp_matches(name, 'infra|live')"

CSV_LINE = """'"' || replace(source, '"', '""') || '","' || source_type || '","' || type || '","' || coalesce(version, '')
  || '","' || repository || '","' || file_path || '",' || line_number || ',"' || file_url || '#L' || line_number || '"'"""

JSON_OBJECT = """'{"name":' || to_json(name) || ',"source":' || to_json(source) || ',"sourceType":' || to_json(source_type)
  || coalesce(',"version":' || to_json(version), '') || ',"repository":' || to_json(repository)
  || ',"filePath":' || to_json(file_path) || ',"fileUrl":' || to_json(file_url) || ',"lineNumber":' || line_number
  || ',"type":' || to_json(type) || '}'"""


def _target(platform, identifier, repository="NULL", host="NULL", error="NULL") -> str:
    return (
        f"{{'platform': {platform}, 'identifier': {identifier}, 'repository': {repository}, 'host': {host}, "
        f"'error': {error}}}"
    )


def _target_error(text: str) -> str:
    return _target("NULL", "NULL", error=text)


_ALIASES = "github, gh, gitlab, gl, bitbucket, bb, local, file, fs"
_OWNER, _NAME = rules.REPO_OWNER, rules.REPO_NAME
_UNSUPPORTED = f"""'Unsupported platform: "svn". Supported platforms: {_ALIASES}'"""
_BAD_URL = "'Invalid URL format: \"' || original_input || '\". ' || "
_ID_RULE = "Must contain only alphanumeric characters, dots, hyphens, and underscores."
_REPO_RULE = "Must contain only alphanumeric characters, dots, hyphens, underscores, and slashes."

# expected result of each form in rules.TARGET, written out
TARGETS = f"""targets AS (
  SELECT c, {rules.TARGET} AS original_input FROM (SELECT c_custkey AS c FROM customer)),
parsed AS (
  SELECT c, original_input, unnest(CASE c % 20
    WHEN 0 THEN {_target("'github'", _OWNER)}
    WHEN 1 THEN {_target("'github'", _OWNER, _NAME)}
    WHEN 2 THEN {_target("'gitlab-self-hosted'", _OWNER, "CASE WHEN c % 3 = 0 THEN NULL ELSE 'a/b' END",
        f"CASE WHEN c % 3 = 0 THEN '{rules.SELF_HOST}' ELSE 'https://git' || c || '.acme.io:8443' END")}
    WHEN 3 THEN {_target("'local'", "'/work/base/y' || c")}
    WHEN 4 THEN {_target_error(f"""'Invalid source format: "' || {_OWNER} || '". Expected format: platform:identifier (e.g., github:myorg, local:/path/to/dir)'""")}
    WHEN 5 THEN {_target_error(_UNSUPPORTED)}
    WHEN 6 THEN {_target_error(f"""'Invalid github identifier: "bad org' || c || '". {_ID_RULE}'""")}
    WHEN 7 THEN {_target("'gitlab'", _OWNER, f"{_NAME} || '/sub'")}
    WHEN 8 THEN {_target("'bitbucket'", _OWNER)}
    WHEN 9 THEN {_target_error("""'Missing identifier after "github:"'""")}
    WHEN 10 THEN {_target("'github'", _OWNER, _NAME, "'https://github.com'")}
    WHEN 11 THEN {_target("'local'", "'/srv/iac' || c || '/'")}
    WHEN 12 THEN {_target_error(f"""'Invalid github repository: "bad repo". {_REPO_RULE}'""")}
    WHEN 13 THEN {_target_error(_BAD_URL + _UNSUPPORTED)}
    WHEN 14 THEN {_target_error(_BAD_URL + "'Invalid URL: missing group/organization in path'")}
    WHEN 15 THEN {_target("'gitlab'", _OWNER, "''")}
    WHEN 16 THEN {_target_error("""'Invalid github identifier: "/x' || c || '". Expected format: org[/repo]'""")}
    WHEN 17 THEN {_target_error(_BAD_URL + "'Invalid URL'")}
    WHEN 18 THEN {_target("'gitlab'", _OWNER, "'tools'", "'https://gitlab.com'")}
    ELSE {_target("'gitlab'", _OWNER, _NAME)} END)
  FROM targets)"""

LOG = f"""log AS (
  SELECT event_id, {rules.LOG_PLATFORM} AS platform, event_type AS operation, {rules.LOG_STATUS} AS status,
    {rules.LOG_CODE} AS code, 'request ' || event_id AS message, {rules.LOG_BODY_MESSAGE} AS body_message FROM events),
failed AS (
  SELECT *, CASE WHEN status IS NULL THEN CASE WHEN code IS NULL THEN 'unknown_error' ELSE 'network_error' END
    ELSE CASE status WHEN 401 THEN 'authentication_failed' WHEN 403 THEN 'authorization_failed'
      WHEN 404 THEN 'resource_not_found' WHEN 429 THEN 'rate_limit_exceeded' ELSE 'platform_error' END END AS error_type
  FROM log WHERE status IS NULL OR status >= 400),
judged AS (
  SELECT *, error_type IN ('rate_limit_exceeded', 'network_error') OR coalesce(status >= 500, false) AS retryable,
    platform <> 'bitbucket' AS known,
    CASE WHEN platform LIKE 'gitlab%' THEN coalesce(body_message, message) ELSE message END AS error_message
  FROM failed)"""

ORACLES = {
    "q_file_type": f"WITH {TREE} SELECT host, full_name, path, {FILE_TYPE} AS file_type FROM tree",
    "q_skip_dirs": f"""WITH {TREE} SELECT host, full_name, path FROM tree
        WHERE NOT list_bool_or(list_concat([false], list_transform(string_split(path, '/')[:-2], lambda d: starts_with(d, '.')
          OR d IN ('node_modules', 'dist', 'build', 'target', '__pycache__'))))""",
    "q_source_type": f"""WITH {CALLS} SELECT source, {source_type_sql("source")} AS source_type, count(*) AS n
        FROM calls GROUP BY source""",
    "q_version": f"WITH {USAGE} SELECT type, source, version, n FROM usage",
    "q_normalize": f"WITH {CALLS} SELECT source, {normalize_sql('source')} AS normalized, count(*) AS n FROM calls GROUP BY source",
    "q_tg_name": f"""WITH {CALLS} SELECT repository, file_path, block_pos,
        {terragrunt_name_sql("file_path", "source")} AS name_by_path,
        {terragrunt_name_sql("'live.hcl'", "source")} AS name_by_source FROM calls""",
    "q_terraform_calls": f"WITH {CALLS} SELECT * FROM calls WHERE type = 'terraform'",
    "q_terragrunt_calls": f"WITH {CALLS} SELECT * FROM calls WHERE type = 'terragrunt'",
    "q_module_calls": f"WITH {CALLS} SELECT * FROM calls",
    "q_union_calls": f"WITH {CALLS} SELECT * EXCLUDE (file_url) FROM calls",
    "q_sorted_calls": f"""WITH {CALLS} SELECT row_number() OVER (ORDER BY {IN_ORDER}) AS position,
        source, version, repository, file_path, line_number, block_pos FROM calls""",
    "q_raw_summary": f"WITH {RAW} SELECT type, source, entry, version, n FROM summary",
    "q_merged_summary": f"WITH {MERGED} SELECT source, entry, version, n FROM merged",
    "q_normalized_summary": f"WITH {NORMALIZED} SELECT module, source_type, versioned, entry, version, n FROM normalized",
    "q_summary_rank": f"""WITH {NORMALIZED} SELECT row_number() OVER (ORDER BY module COLLATE en_us, module, entry,
        version COLLATE en_us NULLS FIRST, version) AS position, module, entry, version, n FROM normalized""",
    "q_source_type_share": f"WITH {SHARES} SELECT CAST(rank AS INTEGER) AS rank, source_type, n, percent FROM source_kinds",
    "q_file_type_share": f"""WITH {SHARES} SELECT rank, type, n,
        {percent_sql("n", "(SELECT count(*) FROM calls)")} AS percent FROM file_kinds""",
    "q_metadata": f"WITH {CALLS} SELECT {COUNTERS}",
    "q_unique_sources": f"""WITH {CALLS} SELECT type, count(DISTINCT source) AS sources,
        count(DISTINCT CASE WHEN version IS NOT NULL THEN source END) AS versioned_sources FROM calls GROUP BY type""",
    "q_csv_file_type": f"""WITH {CALLS},
        relabelled AS (SELECT source, CASE WHEN (line_number % 7 = 0) = (type = 'terraform') THEN 'terragrunt'
          ELSE 'terraform' END AS type, repository, file_path, line_number, block_pos FROM calls)
        SELECT *, CASE WHEN EXISTS (SELECT 1 FROM relabelled t WHERE t.type = 'terraform' AND t.source = r.source
          AND t.file_path = r.file_path) THEN 'terraform' ELSE 'terragrunt' END AS file_type FROM relabelled r""",
    "q_repo_file_counts": f"""WITH {FILES},
        placed AS (SELECT h, repository, file_type FROM files
          UNION ALL SELECT twin, repository, file_type FROM files WHERE twin IS NOT NULL AND {rules.TWIN_HAS}),
        hosted AS (SELECT {rules.REPO_HOST} AS host, repository, file_type FROM placed)
        SELECT host, repository, grouping(repository) = 1 AS overall, count(*) AS files,
        count(*) FILTER (file_type = 'terraform') AS terraform_files,
        count(*) FILTER (file_type = 'terragrunt') AS terragrunt_files FROM hosted GROUP BY GROUPING SETS ((host, repository), ())""",
    "q_csv_rows": f"""WITH {CALLS} SELECT source AS module, source_type, type AS file_type, coalesce(version, '') AS version,
        repository, file_path, line_number, file_url || '#L' || line_number AS file_link FROM calls""",
    "q_csv_lines": f"WITH {CALLS} SELECT row_number() OVER (ORDER BY {IN_ORDER}) AS position, {CSV_LINE} AS line FROM calls",
    "q_json_modules": f"WITH {CALLS} SELECT row_number() OVER (ORDER BY {IN_ORDER}) AS position, {JSON_OBJECT} AS line FROM calls",
    "q_json_document": f"""WITH {MERGED},
        counters AS (SELECT {COUNTERS}),
        placed AS (SELECT *, row_number() OVER (ORDER BY {IN_ORDER}) = 1 AS is_first FROM calls),
        versions AS (SELECT source, string_agg('        ' || to_json(version) || ': ' || n, '#next#' ORDER BY version COLLATE en_us, version) AS lines
          FROM merged WHERE entry = 'version' GROUP BY source),
        sources AS (SELECT m.source, n, lines, row_number() OVER (ORDER BY m.source COLLATE en_us DESC, m.source DESC) = 1 AS is_last
          FROM merged m LEFT JOIN versions v ON m.source = v.source WHERE entry = 'total')
        SELECT '{{' || chr(10) || '  "metadata": {{' || chr(10) || '    "platform": "GitHub",' || chr(10)
          || '    "source": "github:acme",' || chr(10) || '    "target": "acme",' || chr(10)
          || '    "scope": "All repositories in acme",' || chr(10) || '    "timestamp": "2024-01-01T00:00:00.000Z",' || chr(10)
          || '    "moduleCount": ' || module_count || ',' || chr(10) || '    "fileCount": ' || file_count || ',' || chr(10)
          || '    "terraformModuleCount": ' || terraform_module_count || ',' || chr(10)
          || '    "terragruntModuleCount": ' || terragrunt_module_count || ',' || chr(10)
          || '    "terraformFileCount": ' || terraform_file_count || ',' || chr(10)
          || '    "terragruntFileCount": ' || terragrunt_file_count || chr(10) || '  }},' || chr(10) || '  "modules": [' AS value
        FROM counters
        UNION ALL
        SELECT CASE WHEN is_first THEN '' ELSE '    }},' || chr(10) END || '    {{' || chr(10) || '      "name": ' || to_json(name) || ',' || chr(10) || '      "source": ' || to_json(source) || ',' || chr(10)
          || '      "sourceType": ' || to_json(source_type) || ',' || chr(10)
          || coalesce('      "version": ' || to_json(version) || ',' || chr(10), '')
          || '      "repository": ' || to_json(repository) || ',' || chr(10) || '      "filePath": ' || to_json(file_path) || ',' || chr(10)
          || '      "fileUrl": ' || to_json(file_url) || ',' || chr(10) || '      "lineNumber": ' || line_number || ',' || chr(10)
          || '      "type": ' || to_json(type) FROM placed
        UNION ALL SELECT '    }}' || chr(10) || '  ],' || chr(10) || '  "summary": {{'
        UNION ALL
        SELECT '    ' || to_json(source) || ': {{' || chr(10) || '      "count": ' || n || ',' || chr(10) || '      "versions": {{'
          || CASE WHEN lines IS NULL THEN '}}' || chr(10) || '    }}' || CASE WHEN is_last THEN '' ELSE ',' END ELSE '' END FROM sources
        UNION ALL
        SELECT unnest(string_split(replace(lines, '#next#', ',#next#'), '#next#')) FROM sources WHERE lines IS NOT NULL
        UNION ALL
        SELECT '      }}' || chr(10) || '    }}' || CASE WHEN is_last THEN '' ELSE ',' END FROM sources WHERE lines IS NOT NULL
        UNION ALL SELECT '  }}' || chr(10) || '}}'""",
    "q_report_lines": f"""WITH {NORMALIZED}, {_SHARES},
        counters AS (SELECT {COUNTERS}),
        lines AS (
          SELECT 0 AS section, NULL AS source, unnest(generate_series(0, 7)) AS rank, NULL AS version, unnest([
            chr(10) || 'Infrastructure as Code Module Usage Report', '============================', 'Platform: GitHub',
            'Target: acme', 'Scope: All repositories in acme',
            'Total modules found: ' || module_count || ' (' || terraform_module_count || ' Terraform, ' || terragrunt_module_count || ' Terragrunt)',
            'Total files analyzed: ' || file_count || ' (' || terraform_file_count || ' Terraform, ' || terragrunt_file_count || ' Terragrunt)',
            chr(10) || 'Module Summary by Source:']) AS text FROM counters
          UNION ALL
          SELECT 1, module, 0, NULL, chr(10) || module || ' (' || n || ' instances, type: ' || source_type || ')'
          FROM normalized WHERE entry = 'total'
          UNION ALL
          SELECT 1, module, 1, NULL, CASE WHEN versioned THEN '  Versions:' ELSE '  No version constraints found' END
          FROM normalized WHERE entry = 'total'
          UNION ALL
          SELECT 1, module, 2, version, '    - ' || version || ': ' || n || ' instances' FROM normalized WHERE entry = 'version'
          UNION ALL SELECT 2, NULL, 0, NULL, chr(10) || 'Modules by Source Type:'
          UNION ALL SELECT 2, NULL, rank, NULL, '  ' || source_type || ': ' || n || ' modules (' || percent || '%)' FROM source_kinds
          UNION ALL SELECT 3, NULL, 0, NULL, chr(10) || 'Modules by File Type:'
          UNION ALL SELECT 3, NULL, rank, NULL, '  ' || type || ': ' || n || ' modules ('
            || {percent_sql("n", "(SELECT count(*) FROM calls)")} || '%)' FROM file_kinds)
        SELECT section, source, row_number() OVER (ORDER BY section, source COLLATE en_us, source, rank,
          version COLLATE en_us, version) AS line_no, text FROM lines""",
    "q_github_repos": f"""WITH {REPOS} SELECT provider, host, list_pos, owner, name, full_name, default_branch, archived, private, url,
        clone_url FROM repos WHERE provider = 'github'""",
    "q_gitlab_repos": f"""WITH {REPOS} SELECT provider, host, list_pos, owner, name, name AS single_name, full_name, default_branch,
        archived, private, url, clone_url FROM repos WHERE provider = 'gitlab'""",
    "q_ownership": f"""WITH {REPOS}, projects AS (SELECT * FROM repos WHERE provider = 'gitlab'),
        owners AS (SELECT DISTINCT owner, length(owner) % 2 = 0 AS is_group FROM (
          SELECT owner FROM projects UNION ALL SELECT string_split(full_name, '/')[1] FROM projects))
        SELECT list_pos, o.owner, is_group, full_name AS path_with_namespace FROM projects p JOIN owners o
          ON p.owner = o.owner OR (is_group AND starts_with(full_name, o.owner || '/'))""",
    "q_repo_filter": f"""WITH {REPOS} SELECT host, full_name, list_pos, provider, archived, private FROM kept
        WHERE {NAME_PATTERN} AND private""",
    "q_repo_limit": f"""WITH {REPOS}, limited AS (SELECT * FROM kept WHERE {NAME_PATTERN}
        QUALIFY row_number() OVER (PARTITION BY owner ORDER BY list_pos) <= 5)
        SELECT owner, host, full_name, list_pos FROM limited WHERE NOT private""",
    "q_repo_limit_listing": f"WITH {REPOS} SELECT host, full_name, list_pos, archived FROM firsts ORDER BY list_pos LIMIT 50",
    "q_repo_dedup": f"WITH {REPOS} SELECT host, full_name, list_pos FROM firsts",
    "q_skip_counters": f"""WITH {REPOS}, judged AS (
          SELECT *, row_number() OVER (PARTITION BY host, owner, full_name ORDER BY list_pos) > 1 AS is_duplicate FROM repos)
        SELECT owner, count(*) FILTER (NOT is_duplicate AND NOT archived AND {NAME_PATTERN}) AS kept,
          count(*) FILTER (NOT is_duplicate AND archived) AS skipped_archived,
          count(*) FILTER (NOT is_duplicate AND NOT archived AND NOT {NAME_PATTERN}) AS skipped_pattern,
          count(*) FILTER (is_duplicate) AS duplicates FROM judged GROUP BY owner""",
    "q_repo_exists": f"""WITH {REPOS}, wanted AS (
          SELECT c, {rules.OWN_HOST} AS h FROM (SELECT c_custkey AS c FROM customer))
        SELECT c, {rules.REPO_HOST} AS host, {rules.REPO_OWNER} AS owner,
          CASE WHEN c % 6 = 5 THEN 'missing' WHEN c % 11 = 10 THEN ' ' ELSE {rules.REPO_NAME} END AS name,
          CASE WHEN c % 6 = 5 THEN false WHEN c % 11 = 10 THEN NULL WHEN {rules.REPO_ARCHIVED} THEN NULL ELSE true END AS found,
          CASE WHEN c % 6 <> 5 AND c % 11 = 10 THEN 'Repository name is required and must be a non-empty string' END AS error
        FROM wanted""",
    "q_scan_targets": f"WITH {TARGETS} SELECT c, original_input, platform, identifier, repository, host, error FROM parsed",
    "q_target_header": f"""WITH {TARGETS} SELECT c,
        CASE platform WHEN 'github' THEN 'GitHub' WHEN 'gitlab' THEN 'GitLab' WHEN 'gitlab-self-hosted' THEN 'GitLab Self-Hosted'
          WHEN 'bitbucket' THEN 'Bitbucket' WHEN 'local' THEN 'Local Filesystem' END AS platform_name,
        platform <> 'bitbucket' AS supported,
        CASE WHEN platform IS NOT NULL THEN concat_ws('/', identifier, nullif(repository, '')) END AS target,
        CASE WHEN platform = 'local' THEN 'Local directory: ' || CASE c % 20 WHEN 3 THEN 'y' ELSE 'iac' END || c
          WHEN nullif(repository, '') IS NOT NULL THEN 'Single repository: ' || repository
          WHEN platform IS NOT NULL THEN 'All repositories in ' || identifier END AS scope FROM parsed""",
    "q_single_repo": f"""WITH {TARGETS}, {REPOS}, wanted AS (
          SELECT coalesce(host, CASE platform WHEN 'github' THEN 'https://github.com' WHEN 'gitlab' THEN 'https://gitlab.com' END) AS host,
            identifier, nullif(repository, '') AS repository FROM parsed WHERE platform IS NOT NULL)
        SELECT DISTINCT k.provider, k.host, k.full_name, k.list_pos FROM kept k JOIN wanted w ON k.host = w.host
          AND CASE WHEN w.repository IS NULL
            THEN k.owner = w.identifier OR (k.provider <> 'github' AND starts_with(k.full_name, w.identifier || '/'))
            ELSE k.full_name = w.identifier || '/' || w.repository END""",
    "q_target_limit": f"""WITH {TARGETS}, {REPOS}, wanted AS (
          SELECT DISTINCT coalesce(host, CASE platform WHEN 'github' THEN 'https://github.com' WHEN 'gitlab' THEN 'https://gitlab.com' END) AS host,
            identifier, nullif(repository, '') AS repository FROM parsed WHERE platform IS NOT NULL),
        owned AS (SELECT k.*, w.identifier FROM kept k JOIN wanted w ON k.host = w.host AND w.repository IS NULL
            AND (k.owner = w.identifier OR (k.provider <> 'github' AND starts_with(k.full_name, w.identifier || '/')))
          QUALIFY row_number() OVER (PARTITION BY w.host, w.identifier ORDER BY list_pos) <= 2)
        SELECT host, full_name, list_pos FROM owned UNION
        SELECT k.host, k.full_name, k.list_pos FROM kept k JOIN wanted w ON k.host = w.host
          AND k.full_name = w.identifier || '/' || w.repository""",
    "q_tree_files": f"WITH {CANDIDATES} SELECT file_type, host, repository, path, url, sha, tree_pos FROM candidates",
    "q_type_filter": f"WITH {TREE} SELECT host, full_name, path FROM tree WHERE {FILE_TYPE} = 'terragrunt'",
    "q_path_patterns": f"""WITH {TREE} SELECT host, full_name, path FROM tree
        WHERE regexp_matches(path, '\\.tf$|env[12]/') AND NOT regexp_matches(path, 'node_modules|svc.*9/')""",
    "q_max_files": f"""WITH {CANDIDATES} SELECT host, repository, path, tree_pos FROM candidates
        QUALIFY row_number() OVER (PARTITION BY host, repository ORDER BY tree_pos) <= 3""",
    "q_content_decode": f"""WITH {ATTACHED} SELECT file_type, repository, path, md5(content) AS content_md5
        FROM attached WHERE error IS NULL""",
    "q_partial_failures": f"WITH {ATTACHED} SELECT host, repository, path, provider, error FROM attached WHERE error IS NOT NULL",
    "q_fetch_counts": f"""WITH {ATTACHED} SELECT host, repository, count(*) FILTER (error IS NULL) AS success_count,
        count(*) FILTER (error IS NOT NULL) AS error_count FROM attached GROUP BY host, repository""",
    "q_repo_failures": f"WITH {OUTCOMES} SELECT * FROM outcomes",
    "q_scan_errors": f"""WITH {OUTCOMES} SELECT 'repository' AS kind, host, repository, NULL AS path, provider, error FROM outcomes WHERE status = 'error'
        UNION ALL SELECT 'file', host, repository, path, provider, error FROM attached WHERE error IS NOT NULL""",
    "q_scan_totals": f"""WITH {OUTCOMES} SELECT count(*) FILTER (status = 'success') AS repository_successes,
        count(*) FILTER (status = 'error') AS repository_errors, sum(success_count)::BIGINT AS file_successes,
        sum(error_count)::BIGINT AS file_errors FROM outcomes""",
    "q_scan_owner": f"""WITH {CALLS}, {_ATTACHED}
        SELECT calls.* REPLACE (a.url AS file_url) FROM calls JOIN attached a ON calls.repository = a.repository AND calls.file_path = a.path
        WHERE a.error IS NULL""",
    "q_fetch_errors": f"""WITH {LOG} SELECT event_id, platform, operation, status, error_type, retryable, retryable AS is_retryable,
        known AND coalesce(status = 404, false) AS not_found, known AND coalesce(status = 429, false) AS rate_limited,
        known AND coalesce(status IN (401, 403), false) AS auth_failed, error_message,
        CASE error_type WHEN 'authentication_failed' THEN 'Authentication failed. Please check your token or credentials.'
          WHEN 'authorization_failed' THEN 'Access denied. You may not have permission to access this resource.'
          WHEN 'resource_not_found' THEN 'The requested resource was not found.'
          WHEN 'rate_limit_exceeded' THEN 'Rate limit exceeded. Please wait before making more requests.'
          WHEN 'network_error' THEN 'Network error occurred. Please check your connection.' ELSE message END AS user_message
        FROM judged""",
    "q_error_summary": f"""WITH {LOG} SELECT platform, operation, error_type, count(*) AS errors,
        count(*) FILTER (retryable) AS retryable_errors FROM judged GROUP BY ALL""",
    "q_request_summary": f"""WITH {LOG} SELECT platform, operation, count(*) FILTER (coalesce(status < 400, false)) AS success_count,
        count(*) FILTER (coalesce(status >= 400, true)) AS error_count FROM log GROUP BY ALL""",
}


def all_oracles() -> dict[str, str]:
    return dict(ORACLES)
