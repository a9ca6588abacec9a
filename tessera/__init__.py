"""tessera: a Spark-native analytics engine for source trees and text corpora."""
