"""Fixed values.

Results are only right if these equal the published behaviour of the tool whose
reports this package reproduces: file kinds, word lists, patterns, messages.
"""

# --- fixed values: file kinds -------------------------------------------------
TERRAFORM = "terraform"
TERRAGRUNT = "terragrunt"
FILE_TYPES = [TERRAFORM, TERRAGRUNT]

# --- fixed values: directories a local scan does not enter ---------------------
SKIP_DIRECTORIES = [
    "node_modules",
    ".git",
    ".terraform",
    ".terragrunt-cache",
    "dist",
    "build",
    "target",
    ".vscode",
    ".idea",
    "__pycache__",
    ".DS_Store",
]

# --- fixed values: listing page size -------------------------------------------
PAGE_SIZE = 100

# --- fixed values: whitespace as the block patterns understand it --------------
# (wider than Java's \s: no-break space, byte order mark, Unicode blanks)
SPACE = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"

# --- fixed values: block and attribute patterns --------------------------------
# A block ends at the first closing brace; keywords are not anchored.
TERRAFORM_BLOCK = rf'module{SPACE}+"([^"]+)"{SPACE}+\{{([^}}]*)\}}'
TERRAGRUNT_BLOCK = rf"terraform{SPACE}*\{{([^}}]*)\}}"
SOURCE_ATTRIBUTE = rf'source{SPACE}*={SPACE}*"([^"]+)"'
VERSION_ATTRIBUTE = rf'version{SPACE}*={SPACE}*"([^"]+)"'

# --- fixed values: platforms ----------------------------------------------------
GITHUB = "github"
GITHUB_SELF_HOSTED = "github-self-hosted"
GITLAB = "gitlab"
GITLAB_SELF_HOSTED = "gitlab-self-hosted"
BITBUCKET = "bitbucket"
BITBUCKET_SELF_HOSTED = "bitbucket-self-hosted"
LOCAL = "local"

PLATFORM_NAMES = {
    GITHUB: "GitHub",
    GITHUB_SELF_HOSTED: "GitHub Self-Hosted",
    GITLAB: "GitLab",
    GITLAB_SELF_HOSTED: "GitLab Self-Hosted",
    BITBUCKET: "Bitbucket",
    BITBUCKET_SELF_HOSTED: "Bitbucket Self-Hosted",
    LOCAL: "Local Filesystem",
}

PLATFORM_ALIASES = {
    "github": GITHUB,
    "gh": GITHUB,
    "gitlab": GITLAB,
    "gl": GITLAB,
    "bitbucket": BITBUCKET,
    "bb": BITBUCKET,
    "local": LOCAL,
    "file": LOCAL,
    "fs": LOCAL,
}

GITHUB_PLATFORMS = [GITHUB, GITHUB_SELF_HOSTED]
GITLAB_PLATFORMS = [GITLAB, GITLAB_SELF_HOSTED]
PUBLIC_HOSTS = {GITHUB: "https://github.com", GITLAB: "https://gitlab.com"}
SCANNABLE_PLATFORMS = GITHUB_PLATFORMS + GITLAB_PLATFORMS

# --- fixed values: error classes by response status ------------------------------
STATUS_ERRORS = {
    401: "authentication_failed",
    403: "authorization_failed",
    404: "resource_not_found",
    429: "rate_limit_exceeded",
}

USER_MESSAGES = {
    "authentication_failed": "Authentication failed. Please check your token or credentials.",
    "authorization_failed": "Access denied. You may not have permission to access this resource.",
    "resource_not_found": "The requested resource was not found.",
    "rate_limit_exceeded": "Rate limit exceeded. Please wait before making more requests.",
    "network_error": "Network error occurred. Please check your connection.",
    "invalid_configuration": "Invalid configuration. Please check your settings.",
}

# --- fixed values: messages about scan targets, {} stands for a value --------------
NO_TARGET = "Source must be a non-empty string"
NO_PLATFORM = 'Invalid source format: "{}". Expected format: platform:identifier (e.g., github:myorg, local:/path/to/dir)'
NO_IDENTIFIER = 'Missing identifier after "{}:"'
UNSUPPORTED_PLATFORM = 'Unsupported platform: "{}". Supported platforms: {}'
BAD_IDENTIFIER_FORM = 'Invalid {} identifier: "{}". Expected format: org[/repo]'
BAD_IDENTIFIER = 'Invalid {} identifier: "{}". Must contain only alphanumeric characters, dots, hyphens, and underscores.'
BAD_REPOSITORY = (
    'Invalid {} repository: "{}". Must contain only alphanumeric characters, dots, hyphens, underscores, and slashes.'
)
BAD_URL_FORMAT = 'Invalid URL format: "{}". {}'
BAD_URL = "Invalid URL"
URL_WITHOUT_OWNER = "Invalid URL: missing group/organization in path"

# --- fixed values: scopes of a scan -------------------------------------------------
LOCAL_SCOPE = "Local directory: {}"
REPOSITORY_SCOPE = "Single repository: {}"
OWNER_SCOPE = "All repositories in {}"

# --- fixed values: messages about directories ---------------------------------------
NO_DIRECTORY = "Directory does not exist: {}"
NOT_A_DIRECTORY = "Unable to access directory: {} - Path is not a directory: {}"
DIRECTORY_DENIED = "Permission denied reading directory: {}"

# --- fixed values: messages about repositories and contents -------------------------
OWNER_REQUIRED = "Owner name is required and must be a non-empty string"
REPOSITORY_REQUIRED = "Repository name is required and must be a non-empty string"
BAD_GITHUB_CONTENT = "Unexpected response format from GitHub API"
BAD_GITLAB_CONTENT = "Unexpected response format from GitLab API"
