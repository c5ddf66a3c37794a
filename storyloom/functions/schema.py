"""What a graph of the story may hold."""

from __future__ import annotations

#: Labels with the properties that their nodes may have, and the edges between them.
LABELS = {
    "Character": ["name", "aliases", "description"],
    "Location": ["name", "description"],
    "Event": ["name", "description", "chapter", "story_order", "evidence_chunk"],
    "CharacterState": ["name", "description", "evidence_chunk"],
    "Organization": ["name", "description"],
    "Item": ["name", "description"],
}
PATTERNS = [("Character", "APPEARS_IN", "Event"), ("Location", "HOSTS", "Event"), ("Character", "HAS_STATE", "CharacterState"), ("CharacterState", "ESTABLISHED_IN", "Event"), ("Location", "LOCATED_IN", "Location"), ("Organization", "PART_OF", "Organization"), ("CharacterState", "ABOUT", "Item"), ("CharacterState", "ABOUT", "Organization"), ("CharacterState", "ABOUT", "Character")]
#: Labels whose names are compared by likeness, and those that are one thing if written alike. Nodes of other labels are never merged.
FUZZY, EXACT, FACTS = ["Character"], ["Item", "Location", "Organization"], ["Event", "CharacterState"]
ALIKE = 0.85
