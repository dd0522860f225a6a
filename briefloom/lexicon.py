"""Term lists. Every operator takes them as arguments; these are the defaults."""

from __future__ import annotations

from dataclasses import dataclass

# Terms, scores and ranks below must equal the published behaviour for results to match.

PRIORITY_AI = (
    "Claude", "Mythos", "Glasswing", "Gemini", "Anthropic", "OpenAI", "GPT", "ChatGPT", "Codex", "xAI", "Grok",
    "Google", "model release", "agent", "agentic", "workflow", "tool use", "zero-day", "vulnerability",
    "cybersecurity", "breach", "DeepSeek", "Llama", "Qwen", "Mistral", "GitHub", "arXiv", "managed",
)
PRIORITY_STOCK = ("NVDA", "TSLA", "AMD", "GOOG", "AAPL", "0050", "2330", "00692")

CORE_PROVIDERS = (
    "claude", "anthropic", "gpt", "chatgpt", "openai", "codex", "gemini", "google", "xai", "grok",
)
RENDER_PROVIDERS = ("claude", "anthropic", "gpt", "chatgpt", "openai", "codex", "gemini", "xai", "grok")
NAMED_EVENTS = ("mythos", "glasswing")
HIGH_IMPACT = (
    "mythos", "glasswing", "zero-day", "zero day", "unauthorized access", "data leak", "breach", "vulnerability",
    "cybersecurity",
)
INCIDENT = (
    "unauthorized access", "hack", "hacked", "breach", "compromise", "data leak", "leak", "jailbreak",
    "vulnerability", "zero-day", "zero day",
)
INCIDENT_CONTEXT = ("security", "cybersecurity", "model", "preview", "frontier", "api", "agent", "release")
POSITIVE = (
    "model", "release", "launch", "agent", "api", "sdk", "benchmark", "reasoning", "multimodal", "paper", "arxiv",
    "github", "hugging face", "llm", "open source", "copilot", "transformer", "claude", "gpt", "gemini", "gemma",
    "deepseek", "qwen", "llama", "mistral",
)
NEGATIVE = (
    "lawsuit", "probe", "investigation", "compromise", "breach", "banned", "ban", "fear and loathing", "drama",
    "arrested", "molotov", "shooting", "abuser", "house", "sues", "crime", "victim", "war", "department of war",
)
TRUSTED_TYPES = ("official_news", "model_release", "research", "github_release", "github_repo")

ACADEMY_URL = "openai.com/academy/"
ACADEMY_ALLOW = ("responses", "codex", "projects", "connector", "api", "agent builder")
PROMO = ("marketing teams", "study for finals", "education", "for beginners", "tips", "how to use")
PROMO_ALLOW = ("notebooklm", "notebooks", "codex", "responses")

FEATURE_SIGNAL = (
    "introduces", "introduced", "now available", "rolling out", "rollout", "released", "release", "preview",
    "draft", "new feature", "new mode", "got", "to work", "feels more like", "first impressions", "just shipped",
)
PATCH_MARKERS = ("patch release", "hotfix", "bugfix", "minor fixes", "small patch")
PATCH_HIGH_SIGNAL = (
    "breaking", "security", "agent", "model", "release notes", "api", "claude", "gpt", "gemini", "gemma", "managed",
)

SOURCE_SCORE = {
    "official_news": 100,
    "model_release": 95,
    "research": 90,
    "github_release": 85,
    "github_repo": 80,
    "news": 70,
    "community": 40,
    "unknown": 10,
}
DISPLAY_RANK = {
    "official_news": 0,
    "github_release": 1,
    "model_release": 2,
    "research": 3,
    "github_repo": 4,
    "news": 5,
    "community": 6,
    "unknown": 9,
}
QUOTAS = (
    ("official_news", 6),
    ("news", 4),
    ("model_release", 2),
    ("community", 3),
    ("github_release", 1),
    ("research", 1),
    ("github_repo", 1),
)
REQUIRED_TYPES = ("official_news", "model_release", "github_release")

# Provider classification of an item (in this order), and provider labels for texts (other terms, same order).
PROVIDER_KEYS = (
    ("anthropic", ("anthropic", "claude", "code.claude.com")),
    ("openai", ("openai", "chatgpt", "gpt", "platform.openai.com")),
    ("google", ("google", "gemini", "gemma", "ai.google.dev")),
    ("xai", ("xai", "grok", "docs.x.ai", "x.ai")),
)
PROVIDER_LABELS = (
    ("Anthropic", ("claude", "anthropic")),
    ("OpenAI", ("chatgpt", "openai", "gpt", "codex")),
    ("Google", ("gemini", "google", "gemma", "notebooklm")),
    ("xAI", ("grok", "xai", "x.ai")),
)


@dataclass(frozen=True)
class Lexicon:
    """The term lists one ranking run works with."""

    priority: tuple[str, ...] = PRIORITY_AI
    providers: tuple[str, ...] = CORE_PROVIDERS
    named_events: tuple[str, ...] = NAMED_EVENTS
    high_impact: tuple[str, ...] = HIGH_IMPACT
    incident: tuple[str, ...] = INCIDENT
    incident_context: tuple[str, ...] = INCIDENT_CONTEXT
    positive: tuple[str, ...] = POSITIVE
    negative: tuple[str, ...] = NEGATIVE
    trusted_types: tuple[str, ...] = TRUSTED_TYPES
    promo: tuple[str, ...] = PROMO
    promo_allow: tuple[str, ...] = PROMO_ALLOW


AI = Lexicon()
STOCK = Lexicon(priority=PRIORITY_STOCK)
