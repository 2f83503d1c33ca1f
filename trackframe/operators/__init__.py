"""Operators over detections, tracks, routes and labels."""
