"""Prompts and answers of language models. The model itself is a callable; nothing here calls out."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_EXAMPLES = 3
SHAPE = '{"entities": [{"text": "..", "type": "..", "span": [0, 0]}], "relations": [{"subject": "..", "predicate": "..", "object": ".."}]}'


@dataclass
class PromptTemplate:
    """A named text with {variables}; formatting without one of them is an error."""

    name: str
    template: str
    variables: list[str] = field(default_factory=list)
    examples: list[dict] = field(default_factory=list)
    system_message: str | None = None

    def format(self, **values: str) -> str:
        return self.template.format(**values)


def extraction_prompt(chunk: Column, schema: str = "", examples: list[str] | None = None) -> Column:
    """The prompt for each chunk: schema and up to three examples, if there are any, then task and answer shape."""
    parts: list[Column] = []
    if schema:
        parts.append(F.lit(f"Use these terms:\n{schema}\n"))
    if examples:
        parts.append(F.lit("Examples:\n" + "\n".join(examples[:MOST_EXAMPLES]) + "\n"))
    parts += [F.lit("List the entities and relations of this text:\n"), chunk, F.lit(f"\nAnswer in JSON:\n{SHAPE}")]
    return F.concat(*parts)


def fenced(answer: str, tag: str = "sparql") -> str:
    """The first block fenced with the tag, else the first fenced block, else all of it."""
    for opening in (rf"```{tag}", "```"):
        m = re.search(rf"{opening}\s*(.*?)```", answer, re.S)
        if m:
            return m[1].strip()
    return answer.strip()


class LanguageModel:
    """A callable from prompt to answer with the prompts of the engine around it."""

    def __init__(self, generate: Callable[[str], str]):
        self.generate = generate

    def to_sparql(self, question: str, schema: str = "") -> str:
        known = f"Terms:\n{schema}\n" if schema else ""
        return fenced(self.generate(f"{known}Write one SPARQL SELECT query that answers: {question}"))

    def formalize(self, statement: str, formalism: str = "FOL") -> str:
        return self.generate(f"State in {formalism}, formula only: {statement}").strip()

    def verbalize(self, axiom: str, context: str = "") -> str:
        return self.generate(f"Say in plain words: {axiom}" + (f"\nContext: {context}" if context else "")).strip()

    def explain(self, path: list[str]) -> str:
        return self.generate("Explain these steps:\n" + "\n".join(path)).strip() if path else "No reasoning path is recorded."


def connect(cfg) -> LanguageModel:
    """A model behind a provider's own client, if that is installed: openai, anthropic, or ollama (an OpenAI-like
    server, on this machine unless base_url names another). Any other provider is an error."""
    if cfg.provider in ("openai", "ollama"):
        from openai import OpenAI

        local = cfg.provider == "ollama"
        client = OpenAI(base_url=cfg.base_url or ("http://localhost:11434/v1" if local else None), **({"api_key": "none"} if local else {}))

        def ask(prompt: str) -> str:
            got = client.chat.completions.create(model=cfg.model, temperature=cfg.temperature, max_tokens=cfg.max_tokens, messages=[{"role": "user", "content": prompt}])
            return got.choices[0].message.content

        return LanguageModel(ask)
    if cfg.provider == "anthropic":
        from anthropic import Anthropic

        client = Anthropic()

        def ask(prompt: str) -> str:
            got = client.messages.create(model=cfg.model, temperature=cfg.temperature, max_tokens=cfg.max_tokens, messages=[{"role": "user", "content": prompt}])
            return got.content[0].text

        return LanguageModel(ask)
    raise ValueError(f"unknown provider {cfg.provider!r}")
