"""The default pattern feed: texts aimed at a model rather than at a reader (fixed values): id -> (severity, regex)."""

FEED: dict[str, tuple[float, str]] = {
    "ignore_previous": (0.9, r"\b(ignore|disregard|forget|override)\b.{0,40}\b(previous|prior|above|earlier|all|any|your)\b.{0,40}\b(instructions?|prompts?|rules|directions|guidelines)\b"),
    "chat_markup": (0.9, r"<\|(im_start|im_end|system|endoftext)\|>|\[/?INST\]|<</?SYS>>|^\s*#{2,}\s*(system|instructions?)\s*:"),
    "role_override": (0.85, r"\b(you are now|from now on,? you are|pretend (to be|you are)|act as)\b.{0,50}\b(assistant|ai|model|chatbot|dan|developer mode|unrestricted|jailbroken)\b"),
    "reveal_system": (0.8, r"\b(reveal|print|repeat|show|output|disclose)\b.{0,30}\b(system prompt|hidden instructions?|your (instructions|rules|configuration|prompt))\b"),
    "answer_override": (0.7, r"\b(when|if)\b.{0,15}\b(asked|questioned|queried)\b.{0,80}\b(answer|respond|reply|say|state|tell)\b"),
    "ai_directed": (0.7, r"\b(ai|assistant|language model|llm|chatbot)\b.{0,40}\b(must|should|always|never|shall)\b.{0,40}\b(answer|respond|reply|say|state|claim|tell)\b"),
    "exfiltration": (0.7, r"\b(send|forward|post|upload|transmit|email)\b.{0,40}\b(conversation|chat|credentials|passwords?|history)\b.{0,60}(https?://|www\.)"),
    "jailbreak_terms": (0.6, r"\b(do anything now|jailbreak|developer mode|without (any )?(restrictions|filters|guidelines))\b"),
    "system_prompt_mention": (0.5, r"\b(system prompt|system message)\b"),
    "encoded_payload": (0.5, r"[A-Za-z0-9+/]{120,}={0,2}"),
    "disregard_told": (0.85, r"\b(disregard|forget|ignore)\b.{0,30}\b(what|everything|anything)\b.{0,20}\b(you were told|you know|you were given|said before|above)\b"),
    "no_longer_bound": (0.8, r"\bno longer (bound|restricted|limited|constrained)\b.{0,40}\b(rules|restrictions|guidelines|policies|filters)\b"),
    "print_preceding": (0.8, r"\b(print|repeat|output|show|echo)\b.{0,20}\b(everything|all|the text)\b.{0,25}\b(above|before this|written before|preceding|so far)\b"),
    "cross_tenant": (0.8, r"\b(other|another|all)\s+(tenants?|customers?|organi[sz]ations?|companies)\b.{0,30}\b(data|documents?|records?|invoices?|files?)\b"),
}

#: Patterns that are looked for in raw and in normalised text, whatever the feed says (fixed values).
BUILT_IN: dict[str, str] = {
    "ignore_instructions": r"ignore\s+(all\s+)?(previous\s+)?instructions",
    "reveal_prompt": r"reveal\s+(your\s+)?(system\s+)?prompt",
    "dan_mode": r"you\s+are\s+now\s+in\s+DAN\s+mode",
    "chat_start": r"<\|im_start\|>",
    "system_instruction": r"\[SYSTEM\s+INSTRUCTION",
}
