"""Network-flow anomaly analytics as Spark jobs.

Packets become flows, flows become scores, scores become labels, feedback and
training data.  Every public function takes and returns DataFrames; only the
model arithmetic (matrix products on 18 numbers per row) runs in Python workers.
"""
