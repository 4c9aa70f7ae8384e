"""DataFrame -> DataFrame operators over frames, targets, tracks and events."""
