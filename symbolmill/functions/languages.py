"""Languages by file ending."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Supported endings (case-sensitive) and their language labels.
ENDINGS = {
    ".js": "javascript", ".ts": "typescript", ".jsx": "javascript", ".tsx": "typescript", ".mjs": "javascript", ".cjs": "javascript",
    ".py": "python", ".pyw": "python", ".go": "go", ".rs": "rust", ".java": "java",
    ".c": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".h": "c", ".hpp": "cpp", ".hxx": "cpp",
    ".cs": "csharp", ".lua": "lua", ".luau": "lua", ".rb": "ruby", ".rake": "ruby", ".php": "php", ".swift": "swift",
    ".kt": "kotlin", ".kts": "kotlin", ".scala": "scala", ".sc": "scala", ".ex": "elixir", ".exs": "elixir",
    ".dart": "dart", ".vim": "vim", ".sh": "shell", ".bash": "shell", ".zsh": "shell",
}


def ending(path: Column) -> Column:
    """The ending of a path's last component with its dot, '' if it has none or is all ending (``.env``)."""
    return F.regexp_extract(path, r"[^/\\](\.[^./\\]*)$", 1)


def language_of(path: Column) -> Column:
    """Label of a path's language, ``unknown`` for an unsupported ending, null for a null path."""
    m = F.create_map(*[F.lit(x) for kv in ENDINGS.items() for x in kv])
    return F.when(path.isNull(), F.lit(None)).otherwise(F.coalesce(F.try_element_at(m, ending(path)), F.lit("unknown")))
