"""Training-data operators: ten DataFrame operators over documents and conversations.

Nothing else in the library imports this subpackage; it can be removed as a whole.
"""
