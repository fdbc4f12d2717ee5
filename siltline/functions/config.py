"""Constant tables: languages, extensions, directories, bands, labels."""

from __future__ import annotations

EXTENSIONS = {
    "js": "cjs js jsx mjs ts tsx", "cs": "cs", "java": "java", "c": "c h", "cpp": "cc cpp cxx hpp hxx", "go": "go", "rust": "rs", "kotlin": "kt kts", "php": "php", "swift": "swift",
    "ruby": "rb", "r": "r", "dart": "dart", "scala": "sc scala", "py": "py", "html": "cshtml htm html razor",
}
LANG_OF_EXT = {ext: lang for lang, exts in EXTENSIONS.items() for ext in exts.split()}
LOGGING_EXTS = sorted(e for e, lang in LANG_OF_EXT.items() if lang != "html")
LABELS = dict(x.split("=") for x in "c=C cpp=C++ cs=C# dart=Dart go=Go html=HTML/Razor java=Java js=JS/TS kotlin=Kotlin php=PHP py=Python r=R ruby=Ruby rust=Rust scala=Scala swift=Swift".split())

SKIP_DIRS = sorted(".git .gemini .gradle .idea .lovable .mvn .next .nuxt .pub-cache .vscode Pods __pycache__ bin build coverage dist node_modules obj out packages target vendor".split())
LOGGING_SKIP_DIRS = sorted([*SKIP_DIRS, "lib"])
GENERATED = [f".{x}" for x in "bundle.js d.ts Designer.cs g.cs g.i.cs min.js".split()]

BRACE_LANGS = "c cpp cs dart go java js kotlin php rust scala swift unknown".split()
INDENT_LANGS = "py r ruby".split()
LOG_C_STYLE = "c cpp cs dart go java js kotlin php rust scala swift".split()

BANDS = {"cc": (10, 20, 50, 100), "cog": (15, 25, 50, 100), "nest": (2, 4, 6, 9), "fn": (10, 25, 50, 100)}
BAND_NAMES = ["low", "moderate", "high", "very_high", "extreme"]
LEVELS = "error warn info debug trace".split()
CATEGORIES = ["ui", "business", "config", "test", "types", "markup"]
COMMIT_CATEGORIES = ["bug_fix", "feature", "refactoring", "other"]
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()


def stems(text: str) -> str:
    """One alternation of whole words, of stems with their endings: "fix:ed,es" is fix, fixed, fixes; "!" instead of ":" demands an ending."""
    out = []
    for item in text.split(";"):
        word, mark, ends = item.strip().partition(":") if ":" in item else item.strip().partition("!")
        out.append(word + (f"(?:{ends.replace(',', '|')}){'?' if mark == ':' else ''}" if ends else ""))
    return r"\b(?:" + "|".join(out) + r")\b"


BUG = stems("fix:ed,es,ing; bug:fix,s; hotfix; patch:ed,es,ing; correct:ed,s,ing,ion; solve:d,s; resolve:d,s; repair; issue; error; crash; broken; failing; failed")
FEATURE = stems("add:ed,s,ing; new; implement:ed,s,ing,ation; feature; create:d,s; introduc!e,ed,ing; support:s,ed,ing; enable:d,s; initial; setup; set up")
REFACTOR = stems(
    "refactor:ed,s,ing; refacor:ed,s,ing; clean:ed,s,ing,up; renam!e,ed,ing; restructur!e,ed,ing; reorganiz!e,ed,ing; extract:ed,s,ing; simplif!y,ied,ying; optimiz!e,ed,ing,ation; performance;"
    "moderniz!e,ed,ing; mov!e,ed,ing; migrat!e,ed,ing,ion; upgrad!e,ed,ing; remov!e,ed,ing"
)
