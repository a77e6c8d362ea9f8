"""Parameters of the library's requests: defaults, kinds and ranges, checked before anything is planned."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

NEEDED = object()


@dataclass(frozen=True)
class Param:
    """kind: a type, a tuple of allowed values, a list with the kind of its items, or a dict of Params."""

    kind: Any
    default: Any = NEEDED
    least: float | None = None
    most: float | None = None


# Names, defaults and ranges of each request's parameters.
REQUESTS: dict[str, dict[str, Param]] = {
    "compress_directory": {"path": Param(str), "max_files": Param(int, 100, 1, 500), "include_tests": Param(bool, False)},
    "compress_file": {"path": Param(str), "content": Param(str, None)},
    "context_budget": {
        "items": Param([{"name": Param(str), "content": Param(str), "priority": Param(("critical", "high", "medium", "low"), "medium")}], least=1),
        "budget_tokens": Param(int, 8000, 100),
        "model": Param(("gpt-4", "gpt-3.5", "claude-3", "claude-2", "claude-haiku", "custom"), "claude-3"),
    },
    "detect_duplicates": {
        "items": Param([str], least=1),
        "type": Param(("stack-trace", "file", "tool-output", "message", "context-chunk", "auto"), "auto"),
        "similarity_threshold": Param(float, 0.85, 0, 1),
    },
    "semantic_relevance": {"query": Param(str, least=1), "directory": Param(str), "top_k": Param(int, 10, 1, 50), "file_extensions": Param([str], (".ts", ".tsx", ".js", ".jsx", ".py", ".go", ".rs"))},
    "summarize_conversation": {
        "messages": Param([{"role": Param(("user", "assistant", "system")), "content": Param(str), "timestamp": Param(str, None)}]),
        "preserve_last": Param(int, 3, 0, 20),
    },
    "summarize_logs": {"logs": Param(str), "log_type": Param(("npm", "docker", "build", "test", "terminal", "auto"), "auto")},
    "token_usage_report": {"include_current_request": Param(bool, True), "reset_after": Param(bool, False)},
}


class InvalidParams(ValueError):
    """Every problem found, one to a line."""


def validate(request: str, given: dict[str, Any]) -> dict[str, Any]:
    """given with defaults filled in and unknown names left out; InvalidParams says what does not fit."""
    if request not in REQUESTS:
        raise InvalidParams(f"unknown request: {request}")
    problems: list[str] = []
    out = _fields(REQUESTS[request], given, "", problems)
    if problems:
        raise InvalidParams("\n".join(problems))
    return out


def _fields(params: dict[str, Param], given: dict[str, Any], where: str, problems: list[str]) -> dict[str, Any]:
    out = {}
    for name, param in params.items():
        if given.get(name) is not None:
            out[name] = _value(param, given[name], f"{where}{name}", problems)
        elif param.default is NEEDED:
            problems.append(f"{where}{name}: required")
        else:
            out[name] = param.default
    return out


def _value(param: Param, value: Any, where: str, problems: list[str]) -> Any:
    kind, size = param.kind, None
    if isinstance(kind, tuple):
        if value not in kind:
            problems.append(f"{where}: one of {', '.join(kind)}")
        return value
    if isinstance(kind, list):
        if not isinstance(value, (list, tuple)):
            problems.append(f"{where}: a list")
            return value
        value, size = [_value(Param(kind[0]), x, f"{where}[{i}]", problems) for i, x in enumerate(value)], len(value)
    elif isinstance(kind, dict):
        if not isinstance(value, dict):
            problems.append(f"{where}: an object")
            return value
        return _fields(kind, value, f"{where}.", problems)
    elif kind is float and isinstance(value, (int, float)) and not isinstance(value, bool):
        size = value
    elif not isinstance(value, kind) or kind is int and isinstance(value, bool):
        problems.append(f"{where}: {kind.__name__}")
        return value
    else:
        size = value if kind is int else len(value) if kind is str else None
    if size is not None and param.least is not None and size < param.least:
        problems.append(f"{where}: at least {param.least}")
    if size is not None and param.most is not None and size > param.most:
        problems.append(f"{where}: at most {param.most}")
    return value
