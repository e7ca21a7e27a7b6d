"""Layouts of assets: a scaffold and a finished text for each of a skill, an agent and a workflow.

A layout is a tuple of blocks. A block is a text, `Part(name)`, lines that the renderer makes of a playbook (perhaps none), or
`Given(name, text)`, a text that stands only where that field is filled. Texts hold fields in braces.
"""

from __future__ import annotations

from typing import NamedTuple


class Part(NamedTuple):
    name: str


class Given(NamedTuple):
    name: str
    text: str


#: The texts of the six layouts, in their order on the page.
_SUMMARY = Given("summary", "**Playbook summary (author-supplied):**"), Given("summary", "{summary}")

SKILL_SCAFFOLD = (
    "---\nname: {name}\ndescription: {about}\n---",
    "# {name}",
    "## Source playbook",
    Part("source"),
    *_SUMMARY,
    "## What this skill knows",
    "{knows}",
    Part("shown_sections"),
    "## Inputs",
    "_(Stub. `/codify {name}` declares the typed inputs this skill expects from the calling Claude session — argument names, types, and whether each is required. "
    "Example schema: `user_prompt: string (required)`, `target_path: pathlib.Path (optional)`.)_",
    "## Outputs",
    "_(Stub. `/codify {name}` declares the typed outputs this skill produces — artifacts written to disk, return values, conversation state. "
    "Example schema: `artifact: pathlib.Path | None`, `status: 'completed' | 'partial' | 'failed'`.)_",
    "## How to apply",
    "_(Stub. Run `/codify {name}` in a Claude Code session to have the current agent read the playbook's full lessons.md and turn the knowledge above into an actionable procedure: "
    "ordered steps, the tools to call, and verification checks. Edit by hand after that.)_",
    "## Success criteria",
    "_(Stub. `/codify {name}` declares concrete completion tests — the skill is *done* when X file exists / Y command exits 0 / Z assertion holds. "
    "Without these, callers cannot tell success from silent failure.)_",
    "## Failure modes",
    "_(Stub. `/codify {name}` enumerates the cases this skill explicitly does NOT handle — the negative-space contract that complements the trigger description. "
    "Examples: 'does not handle live videos', 'requires ffmpeg on PATH', 'rejects PDFs with no extractable text'.)_",
    "## Dependencies",
    "_(Stub. `/codify {name}` declares what this skill needs to run — MCP servers, sibling skills it invokes, environment variables, filesystem paths, network reachability. "
    "Cross-references should be explicit so a stale dependency surfaces as a missing-tool error, not as a silent skip.)_",
    "## Source notes",
    "- This skill carries the authority of one tutorial author. Cite the source section when applying claims so the user can trace them back.\n"
    "- **Codify dependency:** the `## Inputs`, `## Outputs`, `## How to apply`, `## Success criteria`, `## Failure modes`, and `## Dependencies` sections above are placeholders until "
    "`/codify` runs. `/codify` is provided by the {codifier}, not {product} itself.{scope}",
)

AGENT_SCAFFOLD = (
    "---\nname: {name}\ndescription: {about}\n---",
    "# {name}",
    "## Role",
    "This is an **orchestrating agent**, not a single-procedure skill. It picks the right specialized skill for each phase of a larger task and cites the source curriculum for sequencing and dependencies.",
    "## Source playbook",
    Part("source"),
    *_SUMMARY,
    "## Curriculum",
    "Distilled from {n} sections of the source playbook. Each row is one topical chunk of the curriculum with its source location, "
    "so the agent can cite specific lessons when picking what to teach or do next.",
    Part("listed_sections"),
    "## Inputs",
    "_(Stub. `/codify {name}` declares the typed inputs this agent accepts — what the user (or another agent) hands over when delegating. "
    "Example: `user_goal: string (required)`, `target_artifact: pathlib.Path (optional)`, `deadline: datetime (optional)`.)_",
    "## Outputs",
    "_(Stub. `/codify {name}` declares the typed outputs this agent produces when the delegated task is complete — final artifacts, summary state, hand-back signals. "
    "Example: `deliverable: pathlib.Path`, `status: 'completed' | 'partial' | 'failed'`, `next_action: string | None`.)_",
    "## Owned skills",
    "_(Stub. `/codify {name}` reads the playbook's lessons.md, identifies which `.claude/skills/*` skills map to which curriculum sections, and writes the orchestration table below. Required schema:)_",
    "| Skill | Curriculum section(s) | When to delegate | Input handoff | Output expected |\n|---|---|---|---|---|\n| _(stub)_ | _(stub)_ | _(stub)_ | _(stub)_ | _(stub)_ |",
    "## When to invoke this agent",
    "_(Stub. `/codify {name}` replaces this with concrete trigger phrases — when to delegate to this agent vs. call a tactical skill directly, "
    "what inputs to expect, and which user phrasings should route here.)_",
    "## Constraints",
    "_(Stub. `/codify {name}` declares the explicit scope of authority — what this agent will NOT do without user confirmation "
    "(e.g., 'does not push to git', 'does not execute SQL against production', 'does not send external messages'), and what it must defer to a human for.)_",
    "## Error handling",
    "_(Stub. `/codify {name}` declares what this agent does when an owned skill fails, returns ambiguous output, or is missing from `.claude/skills/`. "
    "Required cases: (a) skill not found, (b) skill returned failure status, (c) skill produced an output the next step cannot consume, (d) user input is ambiguous between two skills.)_",
    "## Source notes",
    "- This agent represents one curriculum author's view of the role. Cite the source section when picking what to teach or do next.\n"
    "- **Codify dependency:** the `## Inputs`, `## Outputs`, `## Owned skills`, `## When to invoke this agent`, `## Constraints`, and `## Error handling` sections above are placeholders until "
    "`/codify` runs. `/codify` is provided by the {codifier}, not {product} itself.{scope}",
)

WORKFLOW_SCAFFOLD = (
    "---\nname: {name}\ndescription: {about}\nowner_agent: {owner}  # the agent that runs this workflow\n---",
    "# {name}",
    "## Role",
    "This is an **orchestration workflow**, not a skill or an agent. It encodes a deterministic sequence of skill invocations with decision gates, declared data flow, and rollback semantics. "
    "The owning agent dispatches this workflow when the user's request matches the trigger description.",
    "## Source playbook",
    Part("source"),
    *_SUMMARY,
    "## Inputs",
    "_(Stub. `/codify {name}` declares the typed inputs this workflow accepts at the entry boundary — what the calling agent must supply before the first step runs.)_",
    "## Outputs",
    "_(Stub. `/codify {name}` declares the typed outputs this workflow produces at the exit boundary — what the calling agent receives after the last step completes successfully.)_",
    "## Steps",
    "_(Stub. `/codify {name}` reads the playbook's lessons.md, translates the curriculum into an ordered sequence of skill invocations, and writes the table below. Required schema:)_",
    "| # | Skill | Input (from) | Output (to) | Success gate | On failure |\n|---|---|---|---|---|---|\n"
    "| 1 | _(stub)_ | _(input source)_ | _(next step / output)_ | _(assertion)_ | _(retry / rollback / abort)_ |",
    "## Decision gates",
    "_(Stub. `/codify {name}` enumerates branch points where the next step depends on a prior step's output — e.g., 'if `validation.status` == \"passed\" → step 4, else → rollback'. "
    "No conditional logic should live implicitly inside step descriptions; gates must be explicit.)_",
    "## Data flow",
    "_(Stub. `/codify {name}` documents how data moves between steps — what artifact each step produces, what the next step expects, and where the workflow's inputs/outputs enter and exit. "
    "Format: `step_N.output_key → step_M.input_key`.)_",
    "## Rollback",
    "_(Stub. `/codify {name}` defines the reversal procedure for each side-effecting step — what to undo, in what order, and the termination condition. "
    "Workflows without rollback semantics are explicitly marked `rollback_strategy: not_applicable` (read-only) or `rollback_strategy: manual` (operator must repair).)_",
    "## Curriculum reference",
    "Distilled from {n} sections of the source playbook. Steps above should cite these sections so each invocation is traceable.",
    Part("listed_sections"),
    "## Source notes",
    "- This workflow reflects one curriculum author's view of the sequence. Cite the source section for each step so the ordering is auditable.\n"
    "- **Codify dependency:** the `## Inputs`, `## Outputs`, `## Steps`, `## Decision gates`, `## Data flow`, and `## Rollback` sections above are placeholders until "
    "`/codify` runs. `/codify` is provided by the {codifier}, not {product} itself.\n"
    "- **Owner agent:** workflows do not stand alone; the agent named in the `owner_agent` frontmatter key is the dispatch entry point. "
    "If `owner_agent: null`, set it before shipping or the workflow is unreachable from the agent layer.{scope}",
)

SKILL = (
    "{frontmatter}",
    "# {name}",
    "## Source playbook",
    Part("summary_lines"),
    "## What this skill knows",
    Part("knowledge"),
    "## Source-backed procedure",
    Part("procedure"),
    "## Inputs",
    "- `request` (string, required): The user task or question to answer using this source-backed skill.\n"
    "- `source_context` (string, optional): Extra constraints, local paths, versions, or environment details.",
    "## Outputs",
    "- `status`: `completed`, `partial`, or `failed`.\n"
    "- `citations`: Source section labels used to ground the answer.\n"
    "- `artifact_paths`: Files created or modified while applying the skill.",
    "## How to apply",
    "1. Restate the requested outcome and identify which source-backed section labels are relevant.\n"
    "2. Read `lessons.md` or `lessons.json` from the linked {product} playbook when the task needs more detail than the summary above.\n"
    "3. Apply the source procedure or concept using the user's current repository, document, or runtime as the source of truth.\n"
    "4. Cite section labels from this skill when making claims that come from the captured source.\n"
    "5. Verify the result with the smallest relevant command, file inspection, or user-visible check.",
    "## Success criteria",
    "- The user receives an action or answer grounded in at least one captured source section.\n"
    "- Any changed artifact path is reported back to the caller.\n"
    "- The verification step is stated, including blockers when verification cannot run.",
    "## Failure modes",
    "- The request depends on information absent from the captured source.\n"
    "- The source is stale relative to the user's current environment.\n"
    "- Required local files, tools, credentials, or network access are unavailable.",
    "## Dependencies",
    "- {product} playbook artifacts linked below.\n"
    "- Local project, document, or runtime requested by the user.\n"
    "- Optional external tools only when the source procedure explicitly requires them.",
    "## Source notes",
    "- This file was finalized by {product}'s deterministic codifier; no AI provider was required.\n"
    "- Treat the captured source as evidence, not as permission to ignore current local state.",
)

AGENT = (
    "{frontmatter}",
    "# {name}",
    "## Role",
    "Use this agent when the user asks for a broad outcome covered by the captured curriculum. The agent plans the work, delegates tactical parts to existing skills when available, "
    "and keeps section citations attached to source-backed decisions.",
    "## Source playbook",
    Part("summary_lines"),
    "## Curriculum",
    Part("curriculum"),
    "## Inputs",
    "- `request` (string, required): The user goal to plan or execute.\n"
    "- `source_context` (string, optional): Current project, platform, dataset, or environment constraints.",
    "## Outputs",
    "- `status`: `completed`, `partial`, or `failed`.\n"
    "- `citations`: Curriculum section labels used for decisions.\n"
    "- `delegated_tasks`: Skills or subtasks the agent routed during execution.",
    "## Owned skills",
    "| Skill | Curriculum section(s) | When to delegate | Input handoff | Output expected |\n|---|---|---|---|---|\n"
    "| source-backed-playbook-review | All sections | When no more specific skill exists | User request plus relevant section labels | Grounded plan, answer, or next action |",
    "## When to invoke this agent",
    "- The user request spans several sections of the captured curriculum.\n"
    "- The work needs sequencing, comparison, or multiple tactical steps.\n"
    "- A narrow skill is not enough to safely answer the request.",
    "## Constraints",
    "- Do not perform destructive actions without explicit user confirmation.\n"
    "- Do not claim coverage beyond the captured curriculum and current local evidence.\n"
    "- Prefer existing specialized skills for concrete execution steps.",
    "## Error handling",
    "- If a needed owned skill is missing, continue with the source-backed playbook review path and report the gap.\n"
    "- If source sections conflict with current local evidence, prioritize current local evidence and call out the conflict.\n"
    "- If the user request is ambiguous between multiple curriculum paths, ask for the smallest clarifying detail.",
    "## Source notes",
    "- This file was finalized by {product}'s deterministic codifier; no AI provider was required.\n"
    "- Cite source sections when choosing sequencing, delegation, or constraints.",
)

WORKFLOW = (
    "{frontmatter}",
    "# {name}",
    "## Role",
    "Run this workflow when a request should follow the captured source sequence. The workflow is deterministic and source-backed; "
    "the owning agent is responsible for dispatch and user confirmation.",
    "## Source playbook",
    Part("summary_lines"),
    "## Inputs",
    "- `request` (string, required): The user goal to run through the workflow.\n"
    "- `source_context` (string, optional): Current project, artifact, or runtime constraints.",
    "## Outputs",
    "- `status`: `completed`, `partial`, or `failed`.\n"
    "- `citations`: Source section labels used during the workflow.\n"
    "- `final_artifact`: Final file, result, or `null` when the workflow is advisory.",
    "## Steps",
    "| # | Skill | Input (from) | Output (to) | Success gate | On failure |\n|---|---|---|---|---|---|\n{steps}",
    "## Decision gates",
    "- If a section is irrelevant to the user's request, skip it and cite the reason.\n"
    "- If local evidence contradicts the captured source, pause and report the conflict.\n"
    "- If a step requires a missing tool, stop before side effects and ask for setup or an alternate path.",
    "## Data flow",
    "- `request` and `source_context` feed step 1.\n"
    "- Each `step_N_result` feeds the next applicable step.\n"
    "- The final step emits `status`, `citations`, and `final_artifact`.",
    "## Rollback",
    "- Default rollback is manual because source-backed workflows may touch arbitrary local artifacts.\n"
    "- Before any destructive step, capture the current file path, command, or state needed to reverse it.\n"
    "- If rollback cannot be guaranteed, stop and ask for confirmation before proceeding.",
    "## Curriculum reference",
    Part("curriculum"),
    "## Source notes",
    "- This file was finalized by {product}'s deterministic codifier; no AI provider was required.\n"
    "- Owner agent: `{owner}`.",
)

#: Words of lines that are made of sections.
NO_CAPTION = "_(no caption text)_"
STEP_ROW = "| {i} | source-backed-playbook-review | request + {label} | step_{i}_result | section claim is grounded and checked | retry with narrower source context or stop for user input |"
NO_STEP_ROW = "| 1 | source-backed-playbook-review | request | result | source section checked | stop for user input |"
SCAFFOLDS = {"skill": SKILL_SCAFFOLD, "agent": AGENT_SCAFFOLD, "workflow": WORKFLOW_SCAFFOLD}
FINISHED = {"skill": SKILL, "agent": AGENT, "workflow": WORKFLOW}
