"""Module names as columns: which modules an import may mean, which a file has, and which are never local."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import basename, dirname, normal_path, suffixes

# Beginnings and names of modules that no source tree defines itself.
STANDARD_PREFIXES = ("node:", "java.", "javax.", "jakarta.", "kotlin.", "golang.org/x/", "google.golang.org/")
PYTHON_STANDARD = tuple(
    "abc argparse ast asyncio base64 collections contextlib copy csv dataclasses datetime decimal enum functools glob hashlib heapq hmac html "
    "http importlib inspect io itertools json logging math os pathlib pickle random re shutil signal socket sqlite3 string struct subprocess "
    "sys tempfile textwrap threading time traceback typing unittest urllib uuid warnings weakref zipfile".split()
)
SWIFT_STANDARD = tuple(
    "AppKit AVFoundation Combine CoreData CoreGraphics CoreLocation CryptoKit Darwin Dispatch Foundation FoundationNetworking Glibc MapKit "
    "Observation OSLog os SwiftData SwiftUI Testing UIKit UserNotifications WebKit XCTest".split()
)


def _listed(*values: Column) -> Column:
    """The values that aren't empty, each once, in order."""
    return F.array_distinct(F.filter(F.array_compact(F.array(*values)), lambda x: x != ""))


def _all(*lists: Column) -> Column:
    return F.array_distinct(F.filter(F.concat(*lists), lambda x: x != ""))


def never_local(family: Column, module: Column) -> Column:
    """Whether a module is a language's or a platform's own."""
    prefixed = F.lit(False)
    for p in STANDARD_PREFIXES:
        prefixed = prefixed | module.startswith(p)
    return (
        prefixed
        | ((family == "python") & F.split(module, "[.]")[0].isin(*PYTHON_STANDARD))
        | ((family == "swift") & module.isin(*SWIFT_STANDARD))
    )


def python_candidates(module: Column, importer: Column) -> Column:
    """An absolute module and its dotted suffixes; a relative one from the importer's package, a dot more climbing."""
    dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    rest = F.substring(module, dots + 1, F.length(module))
    folders = F.filter(F.split(dirname(importer), "/"), lambda x: x != "")
    base = F.slice(folders, F.lit(1), F.greatest(F.size(folders) - dots + 1, F.lit(0)))
    joined = F.array_join(F.filter(F.concat(base, F.array(rest)), lambda x: x != ""), ".")
    relative = _all(F.array(joined), suffixes(joined, "."), F.array(rest))
    return F.when(dots == 0, _all(F.array(module), suffixes(module, "."))).otherwise(relative)


def go_candidates(module: Column, own: Column | None = None) -> Column:
    """The module; what is left of it after the tree's ``own`` module path; its path suffixes."""
    inside = F.lit(None).cast("string")
    if own is not None:
        inside = F.when(module == own, F.lit(".")).when(module.startswith(F.concat(own, F.lit("/"))), F.substring(module, F.length(own) + 2, F.length(module)))
    return _all(_listed(module, inside), suffixes(module, "/"))


def aliased(module: Column, aliases: dict[str, list[str]]) -> Column:
    """What path aliases make of a module: an exact pattern's targets, or those of ``before*after`` with the star filled in.

    Patterns come from a project's settings, so they are few and are columns of the plan.
    """
    none = F.array().cast("array<string>")
    found = []
    for pattern, targets in aliases.items():
        before, star, after = pattern.partition("*")
        if not star:
            found.append(F.when(module == pattern, F.array(*[F.lit(t) for t in targets])).otherwise(none))
            continue
        fits = module.startswith(before) & module.endswith(after) & (F.length(module) >= len(before) + len(after))
        middle = F.substring(module, F.lit(len(before) + 1), F.length(module) - len(before) - len(after))
        made = F.array(*[F.concat(F.lit(t.partition("*")[0]), middle, F.lit(t.partition("*")[2])) if "*" in t else F.lit(t) for t in targets])
        found.append(F.when(fits, made).otherwise(none))
    return _all(*found) if found else none


def typescript_candidates(module: Column, importer: Column, aliases: dict[str, list[str]] | None = None, base: str | None = None) -> Column:
    """A relative module beside the importer, a bare one by aliases, below ``base`` and as it is; each also as a folder's index."""
    bare = F.regexp_replace(module, r"\.(m|c)?(ts|js)x?$", "")
    both = lambda x: F.array(x, F.concat(x, F.lit("/index")))
    beside = normal_path(F.concat_ws("/", dirname(importer), bare))
    mapped = F.flatten(F.transform(aliased(bare, aliases or {}), both))
    below = both(normal_path(F.concat(F.lit(f"{base}/"), bare))) if base is not None else F.array().cast("array<string>")
    return F.when(bare.startswith("."), _all(both(beside))).otherwise(_all(mapped, below, both(bare)))


def candidates(family: Column, module: Column, importer: Column, go_module: Column | None = None, aliases: dict[str, list[str]] | None = None, base: str | None = None) -> Column:
    """Modules that an import may mean, the likeliest first; of Java, Swift and SQL the module itself."""
    return (
        F.when(family == "python", python_candidates(module, importer))
        .when(family == "go", go_candidates(module, go_module))
        .when(family == "typescript", typescript_candidates(module, importer, aliases, base))
        .otherwise(_listed(module))
    )


def submodule(family: Column, module: Column, symbol: Column) -> Column:
    """The module that an imported symbol would be, if it is one below the module that it is imported from."""
    return F.when(family == "python", F.concat(F.regexp_replace(module, r"\.$", ""), F.lit("."), symbol)).when(
        family == "typescript", F.concat(F.regexp_replace(module, "/$", ""), F.lit("/"), symbol)
    )


def file_modules(family: Column, path: Column) -> Column:
    """The modules that a file has, its canonical one first.

    Python: the dotted path, of a package its folder, and its suffixes.  Go: the folder and its suffixes.
    TypeScript: the path without extension, the path, the path as compiled, and the folder of an index.
    Swift: the target below Sources or Tests, or the first folder.
    """
    stem = F.regexp_replace(path, r"\.[^./]+$", "")
    package = F.regexp_replace(F.regexp_replace(stem, r"(^|/)__init__$", ""), "/", ".")
    folder = F.when(dirname(path) == "", F.lit(".")).otherwise(dirname(path))
    index = F.when(basename(stem) == "index", dirname(path))
    target = F.when(path.rlike(r"(^|/)(Sources|Tests)/[^/]+/"), F.regexp_extract(path, r"(?:^|/)(?:Sources|Tests)/([^/]+)/", 1)).otherwise(
        F.when(dirname(path) != "", F.split(path, "/")[0])
    )
    return (
        F.when(family == "python", _all(F.array(package), suffixes(package, ".")))
        .when(family == "go", _all(F.array(folder), suffixes(folder, "/")))
        .when(family == "typescript", _listed(stem, path, F.concat(stem, F.lit(".js")), index))
        .when(family == "swift", _listed(target))
        .otherwise(F.array().cast("array<string>"))
    )


def exported_as(family: Column, kind: Column, name: Column, signature: Column, holder: Column) -> Column:
    """Whether a definition can be seen outside of its file, by its name or by the words before it.

    Java: public or protected, or a member of an interface that isn't private.  Swift: public or open.  TypeScript:
    export before it; a member unless it is private.  ``holder`` is the kind of the type around it.
    """
    hidden = signature.rlike(r"\b(private|fileprivate)\b(?!\(set\))")
    java = ~hidden & (signature.rlike(r"\b(public|protected)\b") | (holder == "interface"))
    typescript = F.when(kind == "method", ~hidden & ~name.startswith("#")).otherwise(signature.rlike(r"^export\b"))
    by_words = F.when(family == "java", java).when(family == "swift", signature.rlike(r"\b(public|open)\b")).when(family == "typescript", typescript)
    return F.coalesce(exported(family, name), by_words, F.lit(True))


def exported(family: Column, name: Column) -> Column:
    """Whether a name says that it is exported: no underscore before it in Python, a capital in Go; null elsewhere."""
    return F.when(family == "python", ~name.startswith("_")).when(family == "go", name.rlike(r"^\p{Lu}"))
