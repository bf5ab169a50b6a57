"""DataFrame operators on detections, motion, trajectories, packets and timings."""
