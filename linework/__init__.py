"""Network maps as Spark jobs: lines, corridors, overlays, layout equations, routing and labels over tables."""
