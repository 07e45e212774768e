"""Constants of the engine. Every one can be given as an argument where it is used."""

# What is indexed.
EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".py", ".go", ".rs", ".java", ".c", ".cpp", ".h", ".hpp", ".rb", ".php", ".cs", ".swift", ".kt", ".scala", ".lua", ".sh", ".sql", ".html", ".css", ".dart", ".el", ".clj", ".ex", ".exs", ".m", ".mm", ".f90", ".f95", ".json", ".yaml", ".yml", ".toml", ".xml", ".md", ".mdx", ".txt", ".gitignore", ".dockerfile")
BASENAMES = ("dockerfile", "makefile")
MAX_FILE_BYTES = 2 * 1024 * 1024
# What a walk leaves out unless told otherwise.
IGNORE = ("*.lock", "*.bin", "*.ipynb", "*.pyc", "*.onnx", "*.txt", "*.log", "*.csv", "**/node_modules/**", "**/dist/**", "**/build/**", "**/out/**", "**/target/**", "**/__pycache__/**", "**/coverage/**", "**/venv/**", "**/fixtures/**", "**/benchmark/**", "**/testdata/**", "**/__fixtures__/**", "**/__snapshots__/**", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "bun.lockb", "composer.lock", "Cargo.lock", "Gemfile.lock", ".env", ".env.*", "*.key", "*.pem", "*.p12", "*.pfx", "*.p8", "**/.ssh/**", "id_rsa", "id_ed25519", "*.pub", "**/.gnupg/**", "*.gpg", "**/.aws/**", "**/.gcloud/**", "**/.azure/**", "secrets.*", "credentials.*", ".DS_Store", "**/.idea/**", "**/.vscode/**", "Thumbs.db")

CHUNK_LINES, OVERLAP_LINES = 75, 10
CHUNK_CHARS, OVERLAP_CHARS = 2000, 200
PREAMBLE_LINES, PREAMBLE_CHARS = 30, 1200
DOC_EXTENSIONS = (".md", ".mdx", ".txt", ".rst", ".adoc")
DATA_EXTENSIONS = (".json", ".yaml", ".yml", ".xml", ".csv", ".map")
DATA_LIMIT = 100 * 1024

RRF_K = 60
STAGE1, STAGE2, RERANK_TOP = 200, 40, 20
BLEND = 0.5
PER_FILE = 3
BM25_K1, BM25_B = 1.2, 0.75


def candidates(k: int) -> int:
    """Rows that each retriever returns for a limit of k."""
    return max(5 * k, 500)


def factor(value: str | float | None, default: float) -> float:
    """A boost given as text or number; missing, unreadable and 0 mean the default."""
    try:
        return float(value) or default  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return default
