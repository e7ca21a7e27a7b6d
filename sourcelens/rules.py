"""Rule tables: fixed values that results depend on, as plain data."""

# Injection rules (id, severity, pattern); "s" patterns let a dot match line ends.
#: Names of products that hostile text may address; add your own compiler's name.
ACTORS = ("codex", "claude", "chatgpt", "assistant", "agent", "model", "compiler")
ROLES = ("system", "developer", "assistant", "agent", "compiler", "codex", "claude")


def injection_rules(own_names: tuple[str, ...] = ()) -> list[tuple[str, str, bool, str]]:
    actors, roles = "|".join((*own_names, *ACTORS)), "|".join((*ROLES[:5], *own_names, *ROLES[5:]))
    return [
        ("instruction_override", "critical", True, r"\b(?:ignore|disregard|override|bypass|forget)\b.{0,80}\b(?:previous|prior|above|system|developer|tool|safety|policy|instruction|rules?)\b"),
        ("forbid_system_compliance", "critical", True, r"\b(?:do not|don't|never|stop)\b.{0,80}\b(?:follow|obey|honou?r|respect|apply)\b.{0,80}\b(?:system|developer|previous|prior|above|tool|safety|policy)\b"),
        ("actor_directed_skill_creation", "critical", True, rf"\b(?:{actors})\b\s*[:,-]\s*(?:(?!\n\n).{{0,120}})?\b(?:create|generate|write|save|export|install|mint|publish)\b.{{0,80}}\b(?:skill|agent|workflow|capability|playbook|tool)\b"),
        ("generator_role_reassignment", "high", True, rf"\b(?:you are now|act as|pretend to be|from now on you are|new role:)\b.{{0,120}}\b(?:{roles})\b"),
        ("secret_exfiltration", "critical", True, r"\b(?:read|steal|leak|print|dump|exfiltrate|send|upload|copy)\b.{0,100}\b(?:secret|token|api[_ -]?key|credential|password|private[_ -]?key|env(?:ironment)? variable)\b"),
        ("tool_or_shell_control", "high", True, r"\b(?:run|execute|invoke|call|use|open)\b.{0,100}\b(?:shell|powershell|cmd|terminal|mcp|tool|browser|webhook|http request)\b"),
        ("hidden_instruction_marker", "high", False, r"\b(?:prompt injection|hidden instructions?|system prompt|developer message|jailbreak)\b"),
        ("hostile_output_contract", "high", True, r"\b(?:return|output|respond with|write)\b.{0,80}\b(?:only|exactly|nothing else)\b.{0,80}\b(?:markdown|yaml|json|skill|agent|workflow|frontmatter)\b"),
    ]


SCAN_CHARS, MATCH_LIMIT, SNIPPET_RADIUS = 400_000, 25, 96

# Aliases of rights bases, export intents, source types and export targets.
BASIS_ALIASES = {
    "": "unknown", "unknown": "unknown", "unspecified": "unknown", "owned": "owned", "owner": "owned", "user_owned": "owned",
    "licensed": "licensed", "license": "licensed", "permission": "user_attested_permission", "permitted": "user_attested_permission",
    "user_attested_permission": "user_attested_permission", "creative_commons": "creative_commons", "cc": "creative_commons",
    "public_domain": "public_domain", "pd": "public_domain", "internal": "internal", "internal_sop": "internal", "fair_use": "fair_use",
}
INTENT_ALIASES = {
    "": "private", "private": "private", "personal": "private", "local": "private", "internal": "internal", "team": "internal",
    "public": "public", "publish": "public", "redistribute": "public", "commercial": "commercial",
}
SOURCE_TYPE_ALIASES = {
    "youtube": "youtube_video", "youtube_video": "youtube_video", "youtube_url": "youtube_video", "local_video": "local_video",
    "video_file": "local_video", "web": "web_page", "web_page": "web_page", "html": "web_page", "page": "web_page", "pdf": "pdf",
    "pdf_file": "pdf", "documentation_site": "documentation_site", "docs_site": "documentation_site", "docs": "documentation_site",
}
TARGET_ALIASES = {
    "claude": "claude_code", "claude_code": "claude_code", "claude-code": "claude_code", "codex": "codex", "openai_codex": "codex",
    "cursor": "cursor", "windsurf": "windsurf", "markdown": "markdown", "md": "markdown", "portable_markdown": "markdown",
}
LOW_RISK = ("owned", "licensed", "public_domain", "internal")
MEDIUM_RISK = ("user_attested_permission", "creative_commons", "fair_use")

# Weights of certification dimensions.
WEIGHTS = {
    "sourceFidelity": 0.18, "codification": 0.10, "executionValidation": 0.18, "governance": 0.08, "visualGrounding": 0.08,
    "validatorCoverage": 0.08, "domainCoverage": 0.06, "capabilityIr": 0.06, "rightsGovernance": 0.08, "sourceSecurity": 0.10,
}
CERTIFIED_AT = 0.75

# Words that are no keywords.
STOPWORDS = (
    "the and for are with from this that these those your have has had but not all any can you use will into out more when what which "
    "how why about also some such only own than too very just now page section their his her its our via see should would could may "
    "might must been being was were they them then there here each few most other same between before after above below during through "
    "over under again further lit node part video tutorial everybody welcome today lesson topic intro introduction overview summary note "
    "tip subscribe channel thanks watching watch like comment share tuned stay coming soon hey guys let lets make sure thing things really "
    "okay want going gonna going-to one two three four five first second third another many much way ways kind kinds lot lots reliably "
    "easily quickly simply actually basically needed need needs good great better best"
).split()
URL_TOKENS = "https http file www com org net io dev html htm php asp aspx pdf docx xlsx".split()
URL_PATTERN = r"https?://\S+|file:///\S+|www\.\S+"
KEYWORD_PATTERN, TOKEN_PATTERN = r"[a-z][a-z0-9\-]{2,}", r"[a-zA-Z0-9][a-zA-Z0-9_\-]{2,}"

# Words of domains, and path segments and titles that name no topic.
DOMAINS = {
    "code": ("code", "python", "javascript", "typescript", "api", "function", "test"),
    "browser": ("browser", "click", "page", "form", "selector", "login"),
    "document": ("pdf", "document", "docx", "page", "paragraph", "table"),
    "api": ("endpoint", "request", "response", "json", "token", "webhook"),
    "data": ("csv", "sql", "spreadsheet", "data", "row", "column"),
}
GENERIC_SEGMENTS = "docs doc documentation getting-started quickstart quick-start intro introduction guides guide reference api manual en en-us latest stable".split()
IGNORED_HOST_PARTS = "www docs doc developer developers learn help".split()
ROLE_TITLE = r"\b(bootcamp|masterclass|curriculum|roadmap|syllabus|full\s+course|complete\s+course|complete\s+guide|career|become\s+an?|from\s+zero\s+to|step[\s-]by[\s-]step\s+(?:guide|tutorial))\b"
TITLE_STRIPS = (
    r"\s*[—\-]\s*MDN\s*$", r"\s*\|\s*MDN\s*$", r"\s+in\s+\d+\s+(?:Seconds?|Minutes?|Hours?)\s*$", r"\s*FULL COURSE\s*", r"\s*Complete (?:Tutorial|Course|Guide)\s*",
    r"\s*Tutorial for Beginners?\s*", r"\s*for Beginners?\s*", r"\s*Tutorial\s*$", r"\s*Course\s*$", r"\s*Guide\s*$", r"\s*\[\d{4}\]\s*", r"\s*\(\d{4}\)\s*",
    r"^\s*(?:19|20)\d{2}\s+", r"\s*\bfor\s+FREE\b\s*", r"\s*\bFREE\b\s*", r"\s*\[\s*\d+\s*\+?\s*(?:Hours?|Minutes?)\+?\s*\]\s*", r"\s*\[\s*\d+\+\s*(?:Hours?|Minutes?)\s*\]\s*",
    r"\s*\bBootcamp\b(?:\s+(?:for|and|with|to|in))?\s*$", r"\s*\bMasterclass\b(?:\s+(?:for|and|with|to|in))?\s*$", r"\s*\bRoadmap\b(?:\s+(?:for|and|with|to|in))?\s*$",
    r"\s*\bCurriculum\b(?:\s+(?:for|and|with|to|in))?\s*$", r"\s*\bSyllabus\b(?:\s+(?:for|and|with|to|in))?\s*$", r"\s+(?:for|and|with|to|by|in)\s*$",
)

# Texts of descriptions and lead-ins by kind of source; {t} is the topic, "" any other kind.
INPUT_PHRASES = {
    "youtube_video": "a tutorial video URL", "web_page": "a single docs URL", "pdf": "a PDF / vendor whitepaper", "documentation_site": "a docs site root URL",
    "": "source material on this topic",
}
TRIGGER_PHRASES = {
    "youtube_video": ("explain {t}", "how does {t} work", "walk me through {t}"),
    "web_page": ("what is {t}", "explain {t}", "{t} reference"),
    "pdf": ("summarize this {t} document", "what does the {t} doc say", "explain {t}"),
    "documentation_site": ("how do I use {t}", "explain {t}", "{t} docs"),
    "": ("explain {t}", "what is {t}", "how does {t} work"),
}
PROCEDURE_LEADS = {
    "youtube_video": "Apply lessons from a tutorial about {t}", "web_page": "Apply guidance from a docs page about {t}",
    "pdf": "Apply guidance from a PDF document about {t}", "documentation_site": "Apply guidance from documentation about {t}",
    "": "Apply lessons about {t}",
}
KNOWS = {
    "youtube_video": "Each row below is one topical chunk of the tutorial with its video timestamp, so claims can be traced back to the source.",
    "pdf": "Each row below is one page of the source PDF, so claims can be traced back to the page.",
    "web_page": "Each row below is one heading-delimited section of the source page, so claims can be traced back to the heading.",
    "documentation_site": "Each row below is one heading-delimited section across the crawled docs pages, so claims can be traced back to the heading.",
    "": "Each row below is one section of the source.",
}
NO_TOPIC, NO_KEYWORDS = "this topic", {"skill": "the concepts covered in the source", "agent": "the source curriculum", "workflow": "the source curriculum"}
DESCRIPTIONS = {
    "skill": "{lead}, covering {kw}. Make sure to use this skill whenever the user asks {asks}, or hands you {input} on this topic, even if they don't name the topic exactly. "
    "(auto-generated from {kind} source; refine via /codify for best matching)",
    "agent": "Orchestrating agent for end-to-end {t} work, covering {kw}. Make sure to use this agent whenever the user asks {asks}, or hands you a multi-skill {t} task, "
    "even if they don't ask for an 'agent' by name. Delegates to the skills listed in `## Owned skills` (filled in by /codify). "
    "(auto-generated from {kind} source; refine via /codify for best matching)",
    "workflow": "Orchestration workflow for {t} that sequences skills with decision gates, data flow, and rollback, covering {kw}. Make sure to use this workflow whenever the user says "
    "'run the {t} workflow', 'walk through {t} end-to-end', or hands you a multi-step {t} task that needs deterministic ordering. "
    "(auto-generated from {kind} source; refine via /codify for best matching)",
}
AGENT_TRIGGERS = ("become a {t}", "learn {t} end-to-end", "build a {t} portfolio")
