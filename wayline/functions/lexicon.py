"""Ways to phrase an action.

The default table is below; any other one is passed as a mapping of the same shape.
"""

from __future__ import annotations

# Phrases per action, the plain one first.
ACTION_PHRASES = {
    "move forward": [
        "go forward", "move forward", "keep going", "keep moving", "walk ahead", "continue forward", "head straight",
        "proceed forward", "move ahead", "walk straight", "go straight", "keep walking", "carry on", "step forward",
        "continue straight", "proceed",
    ],
    "turn left": ["turn left", "go left", "take a left", "make a left turn", "head left", "move left"],
    "turn right": ["turn right", "go right", "take a right", "make a right turn", "head right", "move right"],
    "stop": [
        "stop", "pause", "halt", "freeze", "wait", "stand still", "stop moving", "stop now", "stop immediately",
        "hold still", "come to a stop", "stay there", "stand by", "stay still", "hold position",
    ],
    "enter": ["enter", "go in", "walk in", "step in", "go inside", "walk inside", "move in", "head inside"],
    "pass": ["pass by", "go past", "walk past", "move past", "walk through", "go through", "cross", "keep going"],
    "leave": ["leave", "go out", "get out", "walk out", "step out", "head out", "move out", "exit"],
}
