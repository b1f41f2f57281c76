"""Roles played by a model that a server offers over the common chat-completions protocol.

The server's address and the model's name are parameters; nothing is contacted before a role is asked,
and then from the workers. A failure is raised, and the stages make it a status of the row.
"""

from __future__ import annotations

import base64
import json
import urllib.request
from dataclasses import dataclass

from .models import RETRY_NOTE

EXTRACT = {
    "text": "Rewrite the passage as clean structured text.",
    "table": "Describe the table. Add its schema: columns, row_count and units.",
    "figure": "Describe the figure and name its figure_type.",
}
EXTRACT_FORM = "Reply with one JSON object with the fields structured_text, intuition_summary, key_concepts (a list), confidence (0 to 1) and agent_notes."
JUDGE_CHUNK = "Say whether EXTRACTED is faithful to ORIGINAL. Reply with one JSON object with is_valid, issues, verdict_score (0 to 1), validator_notes and, where it is not, corrected_structured_text, corrected_intuition_summary and corrected_key_concepts."
JUDGE_ANSWER = "Say whether each claim of the answer is found in the sources. Reply with one JSON object with is_grounded, hallucinations (a list), revised_answer, verdict_score (0 to 1) and validator_notes."
GENERATE = "Answer the question from the numbered sources of the context only, and cite file and page of each source you use. Think in a <think> block first. If the sources don't hold the answer, say: Insufficient context"
MAX_TOKENS = {"text": 512, "table": 768, "figure": 768, "judge": 1024, "answer": 2048}


@dataclass(frozen=True)
class ServedModel:
    """url: of the server's ``/v1``; model: its name there."""

    url: str
    model: str
    key: str = ""
    timeout: float = 120.0

    def complete(self, system: str, user: str, max_tokens: int, image: bytes | None = None) -> str:
        content = user if image is None else [
            {"type": "text", "text": user},
            {"type": "image_url", "image_url": {"url": "data:image/png;base64," + base64.b64encode(image).decode()}},
        ]
        body = {"model": self.model, "max_tokens": max_tokens, "temperature": 0, "messages": [{"role": "system", "content": system}, {"role": "user", "content": content}]}
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        request = urllib.request.Request(f"{self.url.rstrip('/')}/chat/completions", json.dumps(body).encode(), headers)
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            return json.load(reply)["choices"][0]["message"]["content"]

    def extractor(self, chunk_type: str, content: str, retry: bool, image: bytes | None = None) -> str:
        return self.complete(f"{EXTRACT[chunk_type]} {EXTRACT_FORM}", content + (RETRY_NOTE if retry else ""), MAX_TOKENS[chunk_type], image)

    def chunk_judge(self, text: str, sources: str, image: bytes | None = None) -> str:
        return self.complete(JUDGE_CHUNK, f"[ORIGINAL]\n{sources}\n\n[EXTRACTED]\n{text}", MAX_TOKENS["judge"], image)

    def answer_judge(self, text: str, sources: str, image: bytes | None = None) -> str:
        shown = sources if "[ANSWER]" in sources else f"[ANSWER]\n{text}\n\n{sources}"
        return self.complete(JUDGE_ANSWER, shown, MAX_TOKENS["judge"], image)

    def generator(self, question: str, context: str) -> str:
        return self.complete(GENERATE, f"[CONTEXT]\n{context}\n\n[QUESTION]\n{question}", MAX_TOKENS["answer"])
