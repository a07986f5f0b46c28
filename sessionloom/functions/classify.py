"""Column builders that classify texts, commands and tool results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sessionloom.functions.text import let

# Word lists and patterns of the report contract.
WORK_AREAS = (
    ("research_writing", ("paper", "manuscript", "reviewer", "latex", "abstract", "introduction", "论文", "稿件", "投稿", "审稿", "章节")),
    ("experiments_data", ("experiment", "dataset", "analysis", "metric", "csv", "benchmark", "实验", "数据", "分析", "指标", "结果")),
    ("skills_configuration", ("skill", "plugin", "mcp", "agents.md", "dsh", "config", "技能", "插件", "配置", "同步")),
    ("documents_presentations", ("docx", "document", "ppt", "slide", "pdf", "report", "文档", "报告", "幻灯片", "演示", "验收", "合同", "材料")),
    ("software_engineering", ("code", "bug", "test", "implement", "refactor", "build", "api", "代码", "实现", "修复", "测试", "重构", "开发")),
    ("web_sites", ("website", "html", "css", "jekyll", "frontend", "page", "网页", "网站", "前端", "页面", "主页")),
)
CORRECTION = r"(?iU)(?:\b(?:no|not that|instead|wrong|stop|actually|rather than|misunderstood)\b|不要|不是这样|不对|错了|改为|重新|你误解|别这样)"
ACCEPTANCE = r"(?iU)^\s*(?:验收通过|我接受(?:这个)?结果|结果可以|通过验收|accepted|i accept(?: this result)?|looks good)\s*[。.!！]?\s*$"
COMMANDS = {
    "content_dump": r"(?i)(?:Get-Content|Select-String|\brg\b|\bgrep\b|\bcat\b|\btype\b|sed\s+-n\b|\bhead\b|\btail\b)",
    "diagnostic": r"(?i)\b(?:Test-Path|Get-Command|where\.exe|git\s+diff\s+--quiet|git\s+rev-parse|rg\b|grep\b|Select-String)\b",
    "verification": r"(?i)(?:\b(?:pytest|unittest)\b|\bpython(?:\.exe)?\b[^\r\n]{0,200}\b(?:test|validate|doctor|smoke|audit|check)[\w.-]*\.py\b|\b(?:npm|pnpm|yarn)\s+(?:run\s+)?test\b|\b(?:validate|doctor|smoke|audit|check)[\w.-]*(?:\.py|\.ps1|\.sh)?\b)",
    "state_change": r"(?i)\b(?:apply_patch|install|pip\s+install|npm\s+install|git\s+(?:pull|fetch|merge|rebase)|New-Item|Set-Content|Copy-Item|Move-Item|Remove-Item|mkdir|touch)\b",
    "commit": r"(?i)\bgit\s+commit\b",
}
CAUSES = (
    ("permission_boundary", r"(?i)(?:permission denied|operation not permitted|access is denied|outside (?:the )?sandbox|requires escalated permissions|EACCES)"),
    ("timeout", r"(?i)(?:timed? out|timeout expired|TimeoutExpired)"),
    ("missing_dependency", r"(?i)(?:ModuleNotFoundError|No module named|command not found|is not recognized as the name)"),
    ("encoding_locale", r"(?i)(?:Unicode(?:Encode|Decode|Translate)?Error|codec can't encode|invalid utf-?8)"),
    ("shell_syntax", r"(?i)(?:ParserError|SyntaxError|unexpected token|parse error)"),
    ("missing_path", r"(?i)(?:cannot find path|no such file or directory|path does not exist|找不到路径)"),
    ("network_auth", r"(?i)(?:authentication failed|permission denied \(publickey\)|could not resolve host|connection refused|proxy error|HTTP (?:401|403|407))"),
    ("test_validation", r"(?i)(?:\bFAILED\b|tests? failed|validation failed|doctor.*failure)"),
)
MENTION = r"(?i)(?<![\w-])\$([a-z0-9]+(?:-[a-z0-9]+)+)(?![\w-])"


def work_area(c: Column) -> Column:
    """The area with most keyword hits; the earlier of equals; general without any."""

    def hits(text: Column, words: tuple[str, ...]) -> Column:
        # most words do not occur at all, which is cheap to see
        each = [F.when(text.contains(w), (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(w), F.lit("")))) / len(w.encode())).otherwise(0) for w in words]
        return reduce(lambda a, b: a + b, [x.cast("int") for x in each])

    names = F.array(*[F.lit(name) for name, _ in WORK_AREAS])
    best = lambda n: F.when(F.array_max(n) == 0, "general").otherwise(F.get(names, F.array_position(n, F.array_max(n)).cast("int") - 1))
    return let(let(F.lower(c), lambda t: F.array(*[hits(t, words) for _, words in WORK_AREAS])), best)


def is_correction(c: Column) -> Column:
    return c.rlike(CORRECTION)


def is_acceptance(c: Column) -> Column:
    return c.rlike(ACCEPTANCE)


def command_flag(c: Column, kind: str) -> Column:
    return c.rlike(COMMANDS[kind])


def mentions(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(MENTION), F.lit(1)), F.lower)


def canonical_tool(c: Column) -> Column:
    """The part of a tool's name after its namespace."""
    return F.element_at(F.split(c, r"__|\."), -1)


def family_tool(c: Column) -> Column:
    """A tool's name; the tools of the reference manager's connector are one; unknown without a name."""
    name = F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown"))
    return F.when(F.lower(name).startswith("mcp__zotero__"), "mcp__zotero").otherwise(name)


def tool_classes(name: Column, raw: Column) -> dict[str, Column]:
    """What a tool is for, by its name: asks the user, starts an agent, searches the web, goes through a connector, polls."""
    low, given = F.lower(name), F.lower(raw)
    return {
        "clarifies": low == "request_user_input",
        "starts_agent": low.isin("spawn_agent", "create_agent") | given.isin("subagent", "workflow"),
        "searches_web": low.contains("web") & (low.contains("run") | low.contains("search") | low.contains("query")),
        "through_connector": low.startswith("mcp") | given.contains("mcp__"),
        "polls": low.isin("wait", "wait_agent", "wait_threads", "write_stdin"),
    }


def platform(cwd: Column) -> Column:
    """The kind of machine, by the shape of the working folder."""
    c = F.trim(cwd)
    return (
        F.when(c.rlike(r"^[A-Za-z]:\\"), "windows").when(c.startswith("/Users/"), "macos").when(c.startswith("/"), "posix_other").otherwise("unknown")
    )


def role(origin: Column) -> Column:
    """(role, basis) of a session of today's logs: one that an agent started, or a root."""
    return F.struct(F.when(origin == "subagent", "task_subagent").otherwise("root_task").alias("role"), F.lit("structured").alias("basis"))


def rollout_role(thread: Column, source: Column, parent: Column) -> Column:
    """(role, basis) by a log's thread source, its source (JSON or a text) and its parent's id.

    structured: the fields say so; heuristic: a name in the source, or which fields are there, suggests it.
    """
    kind, has_parent = F.lower(F.coalesce(thread, F.lit(""))), F.coalesce(parent, F.lit("")) != ""
    spawned = F.coalesce(F.get_json_object(source, "$.subagent.thread_spawn").startswith("{"), F.lit(False))
    guards = F.lower(F.coalesce(F.get_json_object(source, "$.subagent.other"), F.lit(""))) == "guardian"
    told = lambda role, basis: F.struct(F.lit(role).alias("role"), basis.alias("basis"))
    sure, guess, agent = F.lit("structured"), F.lit("heuristic"), kind == "subagent"
    return (
        F.when(kind.isin("user", "realtime_voice"), told("root_task", sure)).when(agent & spawned, told("task_subagent", sure)).when(agent & guards, told("action_reviewer", sure))
        .when(agent & F.lower(F.coalesce(source, F.lit(""))).contains("guardian"), told("action_reviewer", guess)).when(agent & has_parent, told("task_subagent", guess))
        .when((kind == "") & ~has_parent, told("root_task", guess)).otherwise(told("unknown_system_rollout", F.when(kind != "", sure).otherwise(guess)))
    )


def is_meta(command_seen: Column, mentions: Column, first_prompt: Column, skill: str, marks: tuple[str, ...]) -> Column:
    """Whether a session is about this kind of report itself: by its command, its skill, or a first prompt that names them."""
    low = F.lower(F.coalesce(first_prompt, F.lit("")))
    named = reduce(lambda a, b: a | b, [low.contains(m) for m in (*marks, *([f"${skill}"] if skill else []))], F.lit(False))
    return F.coalesce(command_seen, F.lit(False)) | F.coalesce(F.array_contains(mentions, skill), F.lit(False)) | (low.contains("insights") & named)


def session_type(turns: Column, calls: Column, changes: Column, searches: Column, agents: Column, minutes: Column) -> Column:
    return (
        F.when((turns <= 1) & (calls <= 2) & (minutes < 2), "quick_check").when(agents > 0, "multi_agent").when(changes > 0, "implementation")
        .when(searches > 0, "research").when(calls >= 10, "tool_driven").otherwise("conversation")
    )


def complexity(turns: Column, calls: Column, patches: Column, agents: Column, minutes: Column) -> Column:
    return 2 * turns + F.least(calls, F.lit(50)) + 4 * patches + 6 * agents + F.least(minutes, F.lit(120)) / 5
