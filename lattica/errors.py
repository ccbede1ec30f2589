"""What the graph operators raise."""


class InvalidArgument(ValueError):
    """A vertex out of range, a zero weight, a size or a range that makes no sense."""


class ImmutableGraph(TypeError):
    """Edges of this representation can't change."""
