"""Rules that derive infrastructure code from the driver's tables.

The tables hold no such code, so every file is computed from one row of ``orders``
or ``documents``: a projection without join, shuffle or grouping. The rules are SQL
expressions that read the same in Spark and DuckDB over the columns

    o  order or document number        c  customer number
    k  number of a block in its file   tg whether the file is a Terragrunt file
"""

NL = "chr(10)"
PART = "('m' || ((o * 31 + k * 17 + c * 7) % 20))"
STEP = "((o + k * 3) % 7)"

ADDRESS = f"""(CASE (o * 13 + k * 5 + c) % 17
    WHEN 0 THEN './modules/' || {PART}
    WHEN 1 THEN '../shared/' || {PART}
    WHEN 2 THEN '/opt/modules/' || {PART}
    WHEN 3 THEN 'terraform-aws-modules/' || {PART} || '/aws'
    WHEN 4 THEN 'git::https://github.com/org/' || {PART} || '.git//sub'
    WHEN 5 THEN 'https://acme.jfrog.io/tf/' || {PART}
    WHEN 6 THEN 'https://dl.example.com/' || {PART} || '.zip'
    WHEN 7 THEN 'app.terraform.io/acme/' || {PART} || '/aws'
    WHEN 8 THEN 'git@github.com:org/' || {PART} || '.git//net'
    WHEN 9 THEN 'git::https://git.acme.io/tf/' || {PART} || '.git'
    WHEN 10 THEN 'example/' || {PART} || (CASE WHEN tg THEN '-tg' ELSE '-tf' END)
    WHEN 11 THEN 'tfr:///terraform-aws-modules/' || {PART} || '/aws'
    WHEN 12 THEN 'https://acme.jfrog.io/tf/' || {PART} || '.tar.gz'
    WHEN 13 THEN 'Example/' || {PART} || '/AWS'
    WHEN 14 THEN 'git::git@ssh.dev.azure.com:v3/o/p/' || {PART}
    WHEN 15 THEN 's3::https://s3.amazonaws.com/store/' || {PART} || '.tar.gz'
    ELSE ' spaced/' || {PART} || ' ' END
  || CASE (c + k) % 7
    WHEN 1 THEN '?ref=v1.' || {STEP}
    WHEN 2 THEN '?version=2.' || {STEP} || '&depth=1'
    WHEN 3 THEN '?depth=1&ref=v3.' || {STEP}
    WHEN 4 THEN '?ref=v1.' || {STEP} || '&version=9&a=1'
    ELSE '' END)"""

NAME = "('p' || o || '_' || k)"
VERSION_LINE = f"(CASE WHEN (c + k) % 7 = 5 THEN '  version = \"~> ' || {STEP} || '.0\"' || {NL} ELSE '' END)"
SHAPE = "((o * 3 + k * 11) % 12)"


def _terraform(head: str, inner: str = "''", newline: str = NL) -> str:
    return (
        f"{head} || '{{' || {inner} || {newline} || '  source = \"' || {ADDRESS} || '\"' || {newline} "
        f"|| {VERSION_LINE} || '}}' || {newline}"
    )


_HEAD = f"'module \"' || {NAME} || '\" '"
TERRAFORM_BLOCK = f"""(CASE {SHAPE}
    WHEN 5 THEN {_terraform(_HEAD, newline=f"chr(13) || {NL}")}
    WHEN 6 THEN 'module "' || {NAME} || '" {{ source = "' || {ADDRESS} || '" }}' || {NL}
    WHEN 7 THEN '/*' || {NL} || {_terraform(_HEAD)} || '*/' || {NL}
    WHEN 8 THEN {_terraform(_HEAD, f"{NL} || '  tags = {{ a = 1 }}'")}
    WHEN 9 THEN 'module "' || {NAME} || '" {{' || {NL} || '  source = ""' || {NL} || '}}' || {NL}
    WHEN 10 THEN {_terraform(f"'submodule' || chr(160) || '\"' || {NAME} || '\"' || chr(9)")}
    WHEN 11 THEN {_terraform(_HEAD, f"{NL} || '  engine_version = \"13\"'")}
    ELSE {_terraform(_HEAD)} END)"""

_PLAIN_TERRAGRUNT = f"'terraform {{' || {NL} || '  source = \"' || {ADDRESS} || '\"' || {NL} || '}}' || {NL}"
TERRAGRUNT_BLOCK = f"""(CASE {SHAPE}
    WHEN 6 THEN 'terraform{{ source="' || {ADDRESS} || '" }}' || {NL}
    WHEN 7 THEN '# off: ' || {_PLAIN_TERRAGRUNT}
    WHEN 8 THEN 'terraform {{' || {NL} || '  extra {{ a = 1 }}' || {NL} || '  source = "lost/x/y"' || {NL} || '}}' || {NL}
    WHEN 9 THEN 'terraform {{' || {NL} || '  source = "   "' || {NL} || '}}' || {NL}
    WHEN 10 THEN 'terraform {{ required_providers {{ aws = {{ source = "hashicorp/' || {PART} || '" }} }} }}' || {NL}
    WHEN 11 THEN 'module "x" {{ source = "ignored/x/y" }}' || {NL}
    ELSE {_PLAIN_TERRAGRUNT} END)"""

BLOCK = f"(CASE WHEN tg THEN {TERRAGRUNT_BLOCK} ELSE {TERRAFORM_BLOCK} END)"

GLUED_BLOCK = f"({BLOCK} || (CASE WHEN k < blocks THEN glue ELSE '' END))"

# one row per order
ORDER_PATH = """(CASE o_orderkey % 6
    WHEN 0 THEN 'env' || (o_orderkey % 4) || '/svc' || o_orderkey || '/terragrunt.hcl'
    WHEN 1 THEN 'svc' || o_orderkey || '/main.tf'
    WHEN 2 THEN 'svc' || o_orderkey || '/vars.tfvars'
    WHEN 3 THEN 'stacks/' || o_orderkey || '.hcl'
    WHEN 4 THEN 'Svc' || o_orderkey || '/_extra.tf'
    ELSE 'svc' || o_orderkey || '/.terraform.lock.hcl' END)"""
ORDER_IS_TERRAGRUNT = "(o_orderkey % 3 = 0)"
ORDER_BLOCKS = "((o_orderkey * 7 + o_custkey) % 9)"
ORDER_START = f"('# order ' || o_orderkey || {NL} || (CASE WHEN o_orderkey % 2 = 0 THEN {NL} ELSE '' END))"

# one row per document; its whole text stands before, between and after the blocks
DOCUMENT_PATH = """(CASE doc_id % 3
    WHEN 0 THEN 'docs/' || doc_id || '/terragrunt.hcl'
    WHEN 1 THEN 'docs/' || doc_id || '/main.tf'
    ELSE 'docs/' || doc_id || '/live.hcl' END)"""
DOCUMENT_IS_TERRAGRUNT = "(doc_id % 3 <> 1)"
DOCUMENT_BLOCKS = "(2 + doc_id % 2)"

# repositories: one per customer number on its own host (column h), and for every fifth one of the same
# full name on another host
OWN_HOST = "(CASE WHEN c % 2 = 0 THEN 'github' WHEN c % 6 = 1 THEN 'self' ELSE 'gitlab' END)"
TWIN_HOST = "(CASE WHEN c % 5 <> 0 THEN NULL WHEN c % 2 = 1 THEN 'github' WHEN c % 3 = 0 THEN 'self' ELSE 'gitlab' END)"
REPO_OWNER = "('org' || (c % 25))"
# namespace of a repository: some GitLab projects lie in a subgroup of their owner
REPO_NAMESPACE = f"(CASE WHEN c % 18 = 1 AND h <> 'github' THEN 'team' || (c % 3) ELSE {REPO_OWNER} END)"
REPO_NAME = """(CASE c % 4
    WHEN 0 THEN 'infra-' || c
    WHEN 1 THEN 'app-' || c
    WHEN 2 THEN 'Platform_' || c
    ELSE 'live.' || c END)"""
REPO_FULL_NAME = f"({REPO_OWNER} || '/' || {REPO_NAME})"
REPO_PROVIDER = "(CASE h WHEN 'github' THEN 'github' WHEN 'self' THEN 'gitlab-self-hosted' ELSE 'gitlab' END)"
SELF_HOST = "https://gitlab.example.com"
REPO_HOST = f"(CASE h WHEN 'github' THEN 'https://github.com' WHEN 'self' THEN '{SELF_HOST}' ELSE 'https://gitlab.com' END)"
REPO_ARCHIVED = "(c % 10 = 0)"
# only a GitLab payload may lack its default branch
REPO_BRANCH = "(CASE WHEN c % 7 = 0 AND h <> 'github' THEN NULL WHEN c % 5 = 1 THEN 'master' ELSE 'main' END)"
REPO_VISIBILITY = "(CASE c % 3 WHEN 0 THEN 'private' WHEN 1 THEN 'public' ELSE 'internal' END)"
REPO_URL = f"({REPO_HOST} || '/' || {REPO_FULL_NAME})"
FILE_URL = f"""(CASE WHEN h = 'github'
    THEN 'https://github.com/' || {REPO_FULL_NAME} || '/blob/' || {REPO_BRANCH} || '/' || path
    ELSE {REPO_URL} || '/-/blob/' || coalesce({REPO_BRANCH}, 'main') || '/' || path END)"""

# listings: some repositories are listed a second time; pages of twins come after all others
AGAIN, TWIN_PAGES = 1_000_000_000, 2_000_000_000
GITHUB_PAGE = f"""('[{{"name":"' || {REPO_NAME} || '","full_name":"' || {REPO_FULL_NAME} || '","default_branch":"' || {REPO_BRANCH}
    || '","archived":' || (CASE WHEN {REPO_ARCHIVED} THEN 'true' ELSE 'false' END)
    || ',"private":' || (CASE WHEN {REPO_VISIBILITY} = 'public' THEN 'false' ELSE 'true' END)
    || ',"html_url":"' || {REPO_URL} || '","clone_url":"' || {REPO_URL} || '.git","owner":{{"'
    || (CASE WHEN c % 12 = 0 THEN 'login":"","name' ELSE 'login' END) || '":"' || {REPO_OWNER} || '"}}}}]')"""
GITLAB_PAGE = f"""('[{{"id":' || c || ',"name":"Display ' || c || '","path":"' || {REPO_NAME} || '","path_with_namespace":"' || {REPO_FULL_NAME}
    || '","default_branch":' || coalesce('"' || {REPO_BRANCH} || '"', 'null')
    || ',"archived":' || (CASE WHEN {REPO_ARCHIVED} THEN 'true' ELSE 'false' END)
    || ',"visibility":"' || {REPO_VISIBILITY} || '","web_url":"' || {REPO_URL} || '","http_url_to_repo":"' || {REPO_URL}
    || '.git","namespace":{{"name":"N","path":"' || {REPO_NAMESPACE} || '"}}}}]')"""

# further tree entries beside a file; ``tree_pos`` is unique per file and leaves room for them
EXTRA_FOLDER = "('extra' || tree_pos)"
EXTRAS = [  # (condition, path, entry type)
    ("o % 11 = 0", f"{EXTRA_FOLDER} || '/README.md'", "blob"),
    ("o % 17 = 0", f"{EXTRA_FOLDER} || '/.terraform.lock.hcl'", "blob"),
    ("o % 19 = 0", f"{EXTRA_FOLDER} || '/node_modules/x/main.tf'", "blob"),
    ("o % 23 = 0", f"{EXTRA_FOLDER} || '.tf'", "tree"),
    ("o % 25 = 0", f"{EXTRA_FOLDER} || '/.cache/y.hcl'", "blob"),
]
HAS_SHA = "(o % 37 <> 0)"
# what a twin has of the files, and what of that was landed; some repositories have no landed tree
TWIN_HAS = "(o % 3 = 0)"
TWIN_IS_LANDED = "(o % 2 = 0)"
HAS_TREE = "(c % 8 <> 3)"
# trees that were landed, some of them without entries
TREE_LANDED = f"({HAS_TREE} OR c % 16 = 3)"

# landed contents: some failed, some plain, some without text
IS_LANDED = "(o % 29 <> 0)"
IS_PLAIN = "(o % 31 = 0)"
IS_EMPTY_RESPONSE = "(o % 41 = 0)"

# scan targets: one text per customer number
TARGET = f"""(CASE c % 20
    WHEN 0 THEN 'github:' || {REPO_OWNER}
    WHEN 1 THEN 'GH:' || {REPO_FULL_NAME}
    WHEN 2 THEN 'gitlab://' || (CASE WHEN c % 3 = 0 THEN 'gitlab.example.com/' || {REPO_OWNER} ELSE 'git' || c || '.acme.io:8443/' || {REPO_OWNER} || '/a/b' END)
    WHEN 3 THEN 'local:./x/../y' || c
    WHEN 4 THEN {REPO_OWNER}
    WHEN 5 THEN 'SVN:' || {REPO_OWNER}
    WHEN 6 THEN 'github:bad org' || c
    WHEN 7 THEN 'gl:' || {REPO_FULL_NAME} || '/sub'
    WHEN 8 THEN 'bb:' || {REPO_OWNER}
    WHEN 9 THEN 'Github:'
    WHEN 10 THEN 'github://github.com/' || {REPO_FULL_NAME} || '?tab=1#top'
    WHEN 11 THEN 'fs:/data/../srv//iac' || c || '/'
    WHEN 12 THEN 'github:' || {REPO_OWNER} || '/bad repo'
    WHEN 13 THEN 'svn://host/' || {REPO_OWNER}
    WHEN 14 THEN 'gitlab://gitlab.com/'
    WHEN 15 THEN 'GitLab:' || {REPO_OWNER} || '/'
    WHEN 16 THEN 'github:/x' || c
    WHEN 17 THEN 'gl://gitlab.com:99999/' || {REPO_OWNER}
    WHEN 18 THEN 'gitlab://user@gitlab.com/' || {REPO_OWNER} || '/my lib/../tools'
    ELSE 'gitlab:' || {REPO_FULL_NAME} END)"""

# request log: one row per event
LOG_PLATFORM = """(CASE user_id % 5
    WHEN 0 THEN 'github' WHEN 1 THEN 'gitlab' WHEN 2 THEN 'github-self-hosted' WHEN 3 THEN 'gitlab-self-hosted'
    ELSE 'bitbucket' END)"""
LOG_STATUS = """(CASE event_id % 9
    WHEN 0 THEN 200 WHEN 1 THEN 401 WHEN 2 THEN 403 WHEN 3 THEN 404 WHEN 4 THEN 429 WHEN 5 THEN 500 WHEN 6 THEN 503
    WHEN 7 THEN 422 ELSE NULL END)"""
LOG_CODE = "(CASE WHEN event_id % 9 = 8 AND event_id % 2 = 0 THEN 'ECONNRESET' ELSE NULL END)"
LOG_BODY_MESSAGE = "(CASE WHEN event_id % 4 = 0 THEN NULL ELSE props END)"
