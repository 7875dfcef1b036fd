"""Whole flows: recordings -> work plans, readings -> matches, exports -> labels, logs -> motion."""
